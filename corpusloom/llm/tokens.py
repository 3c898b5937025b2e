"""Ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary's path is a parameter; the file has to lie at that path on each executor.
Nothing is trained and nothing of it is copied here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a worker keeps at most; the store is emptied beyond.
KEPT_WORDS = 800_000
#: Bytes of text that are encoded at a time (one longer text is a portion of its own).
PORTION = 16 << 20

#: White space other than the space and the line feed.
OTHER_SPACE = tuple("\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　")
#: Texts with white space of this kind are encoded whole, not word by word.
UNEVEN = "[ \n][ \n]|\\A[ \n]|[ \n]\\z|[" + "".join(OTHER_SPACE) + "]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def portions(rows, texts: pa.Array, size: int | None = None):
    """rows (a batch or an array) in slices of about size (PORTION) bytes of the texts beside them."""
    import numpy as np

    chars = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(chars, (chars[a - 1] if a else 0) + (size or PORTION), "right")))
        yield rows.slice(a, b - a)
        a = b


class Encoder:
    """encode_all(texts) gives the ids of many texts; dtype has 2 bytes if all ids fit.

    No token goes on over a single space or line feed, so a word with the space or line feed
    before it has the same ids wherever it stands. The different words of a portion of texts
    are looked up once each; those that aren't known yet are encoded in one call."""

    def __init__(self, path: str):
        import numpy as np

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, before = told["model"], told.get("pre_tokenizer") or {}
        vocabulary = model["vocab"]
        self.size = 1 + max([*vocabulary.values(), *(x["id"] for x in told.get("added_tokens") or [])])
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        made = [vocabulary.get("".join(x if isinstance(x, list) else x.split(" ")), -1) for x in model.get("merges", [])]
        self.by_words = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not told.get("normalizer") and made == sorted(set(made)) and made[0] >= 0
        if self.by_words:
            self._whole = self._byte_level(vocabulary, {x["content"] for x in told.get("added_tokens") or []})
            self._forget()
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self._whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def _byte_level(self, vocabulary: dict[str, int], special: set[str]):
        """The same ids as the file's own library gives (a test compares them), sooner: merges
        whose ids rise are a list of ranks."""
        import numpy as np
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.starts_word = np.zeros(self.size, bool)
        self.starts_word[[i for token, i in ranks.items() if token[:1] in b" \n"]] = True
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _forget(self) -> None:
        self.place = {"\n": 0}
        self.pool = pa.array([self._array(self._whole("\n")).tobytes()], pa.binary())

    def _array(self, ids: list[int]):
        import numpy as np

        return np.asarray(ids, self.dtype)

    def _learn(self, words: list[str]) -> None:
        """Words that begin a line have its line feed before them."""
        import numpy as np

        ids = self._array(self._whole("".join([w if w[0] == "\n" else " " + w for w in words])))
        starts = np.flatnonzero(self.starts_word[ids])
        if len(starts) != len(words):
            raise RuntimeError("a word's ids can't be told from the next one's")
        ends = (np.append(starts, len(ids)) * self.dtype.itemsize).astype(np.int32)
        more = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids.tobytes())])
        self.place.update(zip(words, range(len(self.pool), len(self.pool) + len(words)), strict=True))
        self.pool = pa.concat_arrays([self.pool, more])

    def _portion(self, texts: pa.Array):
        """The ids of all texts, and how many each has."""
        import numpy as np

        if not self.by_words:
            each = [self._array(self._whole(x or "")) for x in texts.to_pylist()]
            return np.concatenate([*each, self._array([])]), np.array([len(x) for x in each], np.int64)
        texts = texts.fill_null("")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        even = pc.if_else(uneven, "", texts)
        # a line feed before each text stands for its start, and goes at the end
        given = pc.binary_join_element_wise("", pc.replace_substring(even, "\n", " \n"), "\n")
        lists = pc.split_pattern(given, " ")
        coded = lists.values.dictionary_encode()
        n_words = len(coded.dictionary)
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n_words], pa.int32()), coded.dictionary), " ")[0].as_py().split(" ")
        if missing := [w for w in words if w not in self.place]:
            if len(self.place) + len(missing) > KEPT_WORDS:
                self._forget()
                missing = [w for w in words if w not in self.place]
            self._learn(missing)
        rows = np.fromiter(map(self.place.__getitem__, words), np.int64, n_words)
        picked = self.pool.take(pa.array(rows[coded.indices.to_numpy()]))
        size = self.dtype.itemsize
        ends = np.frombuffer(picked.buffers()[1], np.int32, len(picked) + 1, picked.offset * 4) // size
        bounds = ends[np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)].astype(np.int64)
        ids = np.frombuffer(picked.buffers()[2], self.dtype, int(ends[-1]))
        kept = np.ones(len(ids), bool)
        kept[bounds[:-1]] = False
        ids, n = ids[kept], np.diff(bounds) - 1
        if not pc.any(uneven).as_py():
            return ids, n
        each = np.split(ids, np.cumsum(n)[:-1])
        for i in np.flatnonzero(uneven.to_numpy(zero_copy_only=False)).tolist():
            each[i] = self._array(self._whole(texts[i].as_py()))
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def encode_all(self, texts: pa.Array):
        """(ids, bounds): the ids of all texts, one after the other; text i has those from
        bounds[i] to bounds[i + 1]."""
        import numpy as np

        ids, n = [self._array([])], [np.zeros(1, np.int64)]
        for part in portions(texts, texts):
            for out, x in zip((ids, n), self._portion(part), strict=True):
                out.append(x)
        return np.concatenate(ids), np.cumsum(np.concatenate(n))

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, as little-endian bytes of dtype."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and path."""
    return Encoder(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens); a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = encoder(path)
        for batch in batches:
            bounds = own.encode_all(batch.column(1))[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64())], names=["doc_id", "n_tokens"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_tokens long")
