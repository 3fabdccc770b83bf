"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe

#: The split of the byte-level vocabulary (fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with these are left to the library: characters which Unicode versions class differently, and the ASCII separators.
ODD = r"[\x1c-\x1f\p{Cn}\p{Co}\p{Cs}]"


@lru_cache(maxsize=2)
def proven(text: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and of which the merges alone make that one token. Run once, on the driver."""
    import regex

    merger, split, found = bpe.Merger(text), regex.compile(PRETOKEN), []
    for symbols, i in merger.vocab.items():
        try:
            s = bytes(merger.value[c] for c in symbols).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split.findall(s) == [s]:
            found.append((s, i))
    ids, n = merger.merge([s.encode() for s, _ in found])
    first = np.cumsum(n) - n
    return frozenset(s for k, (s, i) in enumerate(found) if n[k] == 1 and ids[first[k]] == i)


class Counter:
    """Tokens of texts. Pre-tokens that are proven strings count 1; the rest are merged, at first sight and together, and kept, up to
    `most` of them."""

    def __init__(self, text: str, whole: frozenset[str], most: int = 700_000):
        import regex

        self.library, self.merger, self.whole, self.most = bpe.tokenizer(text), bpe.Merger(text), whole, most + len(whole)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split, self.odd = regex.compile(PRETOKEN).findall, regex.compile(ODD).search
        self.known = dict.fromkeys(whole, 1)

    def own(self, t: str) -> bool:
        return not (any(s in t for s in self.special) or any(c in t for c in "\x1c\x1d\x1e\x1f") or (not t.isascii() and self.odd(t)))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.most:
            self.known = dict.fromkeys(self.whole, 1)
        split = [self.split(t) if self.own(t) else None for t in texts]
        new = sorted(set().union(*(s for s in split if s)).difference(self.known))
        self.known.update(zip(new, self.merger.merge([p.encode() for p in new])[1].tolist(), strict=True))
        get = self.known.__getitem__
        return [len(self.library.encode(t, add_special_tokens=False).ids) if s is None else sum(map(get, s)) for t, s in zip(texts, split, strict=True)]


@lru_cache(maxsize=1)
def counter(text: str, whole: frozenset[str]) -> Counter:
    return Counter(text, whole)


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, as the tokenizers library counts a byte-level .json vocabulary.

    A null text counts as empty (0 tokens), a null id stays null, repeated rows are counted each, other columns play no part.
    One pass over the rows without a shuffle; a worker holds one Arrow batch and a bounded table of counts. What is broadcast is the
    vocabulary file and the proven strings, whose size is that of the vocabulary."""
    spark = df.sparkSession
    vocab = bpe.load(spark, tokenizer_path)
    whole = spark.sparkContext.broadcast(proven(vocab.value))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        count = counter(vocab.value, whole.value).count
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [k for at in range(0, len(texts), 500) for k in count(texts[at : at + 500])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
