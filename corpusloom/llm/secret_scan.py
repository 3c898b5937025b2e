"""Secret scanning: candidates by pattern, false positives removed by a random forest.

Patterns with a wide net find candidates in the whole text: known key formats, values that are
assigned to a telling name, passwords in addresses, private keys to their last line, and long
runs that mix letters and digits or cases. A random forest then
judges each by its length, how likely its character transitions are in words, how much of it a
dictionary covers, its path (the document's source) and the words beside it. The forest is
trained on labelled findings; where none are given, on FINDINGS_MADE examples made from a seed.

The words beside a candidate are those within BEFORE characters before and AFTER after it.

Null and empty texts have no candidate; a null source is an empty path. Repeated rows are
scanned each. Each candidate has a row, with the forest's verdict. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.trees import cuts, grow, predict

FINDINGS_MADE = 6_000
BEFORE, AFTER = 48, 32
TREES, DEPTH = 24, 8
#: Labelled findings that are used at most.
MAX_FINDINGS = 50_000

#: What a telling name ends in, whatever stands before (as in aws_secret_access_key).
NAMES = r"(?:key|token|secret|passw(?:or)?d|pwd|passphrase|credentials?|bearer)"
CANDIDATE = re.compile(
    r"(?P<private_key>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"
    r"|(?P<format>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{20,}|\bxox[abprs]-[0-9A-Za-z-]{10,}|\bsk[-_][0-9A-Za-z_-]{20,}|\bAIza[0-9A-Za-z_-]{30,}|\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]*)"
    r"|://[^\s:/@\"']{1,64}:(?P<login>[^\s:/@\"']{4,})@"
    rf"|(?i:{NAMES})[\"']?\s{{0,3}}(?:=|:=|:|=>)\s{{0,3}}[\"']?(?P<assigned>[^\s\"'<>,;]{{6,}})"
    r"|(?<![0-9A-Za-z+/_-])(?P<run>[0-9A-Za-z+/_-]{20,}={0,2})"
)
#: The line that ends a private key.
KEY_END = re.compile(r"-----END [A-Z ]{0,20}PRIVATE KEY-----")
#: One of these has to be there for any of the patterns to match.
ANY = re.compile(r"[0-9A-Za-z+/_-]{20}|-----BEGIN|AKIA|ASIA|xox|[=:]")

#: Common words, of prose and of programs.
DICTIONARY = tuple(
    "about above access account action admin after again agent alpha also always and another answer any api app apple array assert async author auto back base been before begin being below beta between big block body bool both box build byte cache call can case change channel char check child class clean clear click client close cloud code color column com commit common config connect const content context copy could count create current data date day debug default delete demo deploy design dev device dict different dir direct does down draft drive dummy each edit empty end entry enum error even event every example exec exit export extra fail false fast fetch field file find first fix flag float folder font foo for form format found frame from full func general get git give global good graph great green group guide had hand handle hash have head header hello help here hidden high home host house how html http icon idea image import index info init inner input insert install int into item join json just keep key kind know label large last later layout learn left level lib license light like limit line link list little live load local lock log long look loop main make manager many map mark master match max may menu merge message method might min mode model module more most mount move much must name need net never new next node none not note now null number object off old one only open option order org other our out output over own page param parent parse part pass password path place plan play please plugin point port post print private process program project proxy public pull push put query queue quick random range read real record red ref release remote remove render replace reply report request reset response result return right root route row rule run same sample save say schema scope script search secret section see select self send server service session set shared shell should show sign simple since site size small some sort source space spec split stack stage start state static status step stop store stream string style such sync system table tag take target task temp template test text than that the their them then there these they thing think this those thread through time title to token tool top total track trace tree true try type under unit until update upload url use user util valid value var version very view was wait want way web week well were what when where which while white who why will window with word work world would write year yes you your".split()
)
NEAR = re.compile(r"key|token|secret|passw|pwd|auth|credential|bearer|private|login|api", re.I)
FAR = re.compile(r"commit|sha|md5|checksum|digest|hash|uuid|guid|example|sample|dummy|test|placeholder|version|revision|isbn|order|etag|integrity|fingerprint|image|url|path|file|color", re.I)
PATHS = re.compile(r"test|spec|example|sample|fixture|mock|doc|readme|lock|vendor|min\.", re.I)


@lru_cache(maxsize=1)
def _tables():
    words = set(DICTIONARY)
    counts: dict[str, dict[str, int]] = {}
    for word in DICTIONARY:
        for a, b in zip(f"^{word}", f"{word}$", strict=True):
            counts.setdefault(a, {})[b] = counts.get(a, {}).get(b, 0) + 1
    logs = {a: {b: math.log((n + 0.1) / (sum(row.values()) + 2.8)) for b, n in row.items()} for a, row in counts.items()}
    return words, logs


def _coverage(candidate: str) -> float:
    """The share of its characters that the longest dictionary words from each place on cover."""
    words, _ = _tables()
    low, at, n = candidate.lower(), 0, 0
    while at < len(low):
        for size in range(min(10, len(low) - at), 2, -1):
            if low[at : at + size] in words:
                n += size
                at += size
                break
        else:
            at += 1
    return n / max(1, len(low))


def features(candidate: str, path: str, before: str, after: str) -> list[float]:
    _, logs = _tables()
    n = len(candidate)
    letters = [c for c in candidate.lower() if c.isalpha()]
    rate = sum(logs.get(a, {}).get(b, -4.5) for a, b in zip(letters, letters[1:], strict=False)) / max(1, len(letters) - 1)
    count: dict[str, int] = {}
    for c in candidate:
        count[c] = count.get(c, 0) + 1
    kind = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in candidate]
    digits, uppers = kind.count("d"), kind.count("u")
    return [
        float(n),
        rate,
        -sum(k / n * math.log2(k / n) for k in count.values()),
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / max(1, n - 1),
        digits / n,
        uppers / n,
        kind.count("o") / n,
        _coverage(candidate),
        float(all(c in string.hexdigits for c in candidate)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", candidate))),
        len(count) / n,
        float(bool(NEAR.search(before[-24:]))),
        float(bool(FAR.search(before))) + float(bool(FAR.search(after))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(bool(PATHS.search(path))),
        float(candidate.count("/") + candidate.count("-") + candidate.count(".")) / n,
    ]


def _plain(run: str) -> bool:
    """True for what is words or a number: letters of one case but for capitals that begin words,
    or no letters at all."""
    if any(c.isdigit() for c in run):
        return not any(c.isalpha() for c in run)
    cased = [c.isupper() for c in run if c.isalpha()]
    return sum(a and not b for a, b in zip(cased, cased[1:], strict=False)) < max(3, len(cased) // 6)


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the value, in text order; of a private key, up to its last line, if
    there is one before the next key begins."""
    if not ANY.search(text):
        return
    at = 0
    while m := CANDIDATE.search(text, at):
        kind = m.lastgroup
        start, end = m.span(kind)
        at = m.end()
        if kind == "private_key":
            # no key is looked for beyond the next one's begin, so the text is passed once
            following = text.find("-----BEGIN", at)
            closing = KEY_END.search(text, at, following if following >= 0 else len(text))
            if closing is not None:
                at = end = closing.end()
        if kind != "run" or not _plain(text[start:end]):
            yield start, end, kind


def made_findings(n: int = FINDINGS_MADE, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, path, before, after, 1 if a secret): labelled examples of usual shapes."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(DICTIONARY) for _ in range(k))
    chars = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, base62 = "0123456789abcdef", string.ascii_letters + string.digits
    out = []
    for _ in range(n):
        path = rng.choice(["src{}", "app/config.py", "settings.env", "lib/{}.rb", "main.go", "web{}"]).format(rng.randrange(40))
        name = rng.choice(["token", "api_key", "secret", "password", "apiKey", "access_token", "client_secret", "SECRET_KEY", "auth_token", "key"])
        put = rng.choice([' = "', "=", ": ", ": '", "='", ' := "'])
        if rng.random() < 0.5:
            value = rng.choice([lambda: chars(hexa, rng.choice([32, 40, 48, 64])), lambda: chars(base62, rng.randrange(20, 65)), lambda: chars(base62 + "+/", rng.choice([40, 44, 64])), lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + chars(base62, 36), lambda: "sk-" + chars(base62, 40), lambda: chars(base62 + "!@#%^&*", rng.randrange(10, 24)), lambda: chars(string.ascii_letters, rng.randrange(24, 48)), lambda: rng.choice(DICTIONARY) + chars("0123456789!#$", rng.randrange(1, 5)), lambda: chars(base62, rng.randrange(8, 14))])()
            before = f"{prose(3)} {name}{put}"
            if len(value) < 16:
                # passwords: named so, or in an address
                before = f"{prose(3)} {rng.choice(['password', 'passwd', 'pwd', 'db_password', 'secret'])}{put}" if rng.random() < 0.6 else f"{prose(2)} {rng.choice(['postgres', 'mysql', 'https', 'amqp'])}://{rng.choice(DICTIONARY)}:"
            if value.startswith(("AKIA", "ghp_", "sk-")) and rng.random() < 0.5:
                before = prose(4) + " "
            label = 1
        else:
            label, pick = 0, rng.randrange(10)
            before = f"{prose(3)} {name}{put}"
            if pick == 0:
                value, before = chars(hexa, rng.choice([7, 12, 32, 40, 64])), prose(2) + rng.choice([" commit ", " sha256: ", " md5=", " checksum ", " digest: ", " etag: "])
            elif pick == 1:
                value, before = "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), prose(2) + rng.choice([" uuid=", " id: ", " request "])
            elif pick == 2:
                value = rng.choice(["your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme123", "example_token_1", "<placeholder>", "insert-key-here", "REPLACE_ME_2024", "os.environ['KEY']", "process.env.TOKEN", "${SECRET_KEY}", "12345678", "undefined"])
            elif pick == 3:
                value, before = "/".join(rng.choice(DICTIONARY) for _ in range(rng.randrange(3, 7))) + str(rng.randrange(100)), prose(3) + rng.choice([" see ", " path: ", " url = "])
            elif pick == 4:
                value, before = "_".join(rng.choice(DICTIONARY) for _ in range(rng.randrange(4, 8))) + str(rng.randrange(10)), prose(4) + " "
            elif pick == 5:
                value = "".join(rng.choice(DICTIONARY).capitalize() for _ in range(rng.randrange(3, 6))) + rng.choice(["", "()", "1", "V2"])
            elif pick == 8:
                value, before = rng.choice(DICTIONARY) + rng.choice(DICTIONARY), f"{prose(3)} the {name}: "
            elif pick == 9:
                value, before = "".join(rng.choice(DICTIONARY).capitalize() for _ in range(rng.randrange(4, 7))), prose(4) + " "
            elif pick == 6:
                value, before = f"{rng.randrange(10**9)}-{rng.choice(DICTIONARY)}-{rng.randrange(10**9)}", prose(3) + " order "
            else:
                value, path = chars(base62, rng.randrange(20, 41)), rng.choice(["tests/fixtures/keys.py", "docs/example.md", "spec/sample_test.rb", "package-lock.json"])
                before = f"{prose(2)} example {name}{put}"
        out.append((value, path, before, rng.choice(['"', "", "'", " "]) + " " + prose(2), label))
    return out


def train(findings: list[tuple[str, str, str, str, int]], seed: int = 5) -> list:
    """The forest: each tree from a bootstrap sample, with some of the features at each node."""
    import numpy as np

    x = np.array([features(*f[:4]) for f in findings])
    y = np.array([f[4] for f in findings], float)
    rng, thresholds = np.random.default_rng(seed), cuts(x)
    return [grow(x, y, rng.multinomial(len(y), np.full(len(y), 1 / len(y))).astype(float), thresholds, DEPTH, 4, rng) for _ in range(TREES)]


def probability(forest: list, x):
    return sum(predict(tree, x) for tree in forest) / len(forest)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, start, end, kind, value_sha256, score, is_secret) for each candidate; the value
    itself isn't copied. findings: labelled ones, with columns candidate, path, before, after
    (strings) and label (0 or 1), of which MAX_FINDINGS are used at most."""
    import numpy as np

    if findings is None:
        known = made_findings()
    else:
        rows = findings.select("candidate", "path", "before", "after", "label").na.drop(subset=["candidate", "label"]).na.fill("")
        known = [tuple(x) for x in rows.orderBy(F.xxhash64("candidate", "before"), *rows.columns).limit(MAX_FINDINGS).collect() if x[0]]
    forest = docs.sparkSession.sparkContext.broadcast(train(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, xs = [], []
            for i, (text, path) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                text = text.as_py() or ""
                for start, end, kind in candidates(text):
                    value = text[start:end]
                    rows.append((i, start, end, kind, hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()))
                    xs.append(features(value, path or "", text[max(0, start - BEFORE) : start], text[end : end + AFTER]))
            score = probability(forest.value, np.array(xs)) if xs else np.zeros(0)
            score = np.where([x[3] == "private_key" for x in rows], 1.0, score) if xs else score
            columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.string()),
                    pa.array(columns[4], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(score >= 0.5, pa.bool_()),
                ],
                names=["doc_id", "start", "end", "kind", "value_sha256", "score", "is_secret"],
            )

    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit("")
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, start long, end long, kind string, value_sha256 string, score double, is_secret boolean")
