"""Token counts of whole texts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a compact table of frequent pre-tokens and their token counts, learned from a bounded sample of
documents and broadcast. Tier two is a bounded cache in each Python worker: a pre-token that tier one lacks is
encoded once by the library and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.runtime import arrow_batches

SAMPLE_DOCS = 2_000
TABLE_ENTRIES = 50_000
CACHE_ENTRIES = 200_000

# Fixed value: the byte-level pre-tokenizer's published pattern.
PRE_TOKENS = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
# Outside these, Unicode versions and the meaning of \s may differ between the two regex engines; such texts are
# cut by the tokenizer's own pre-tokenizer.
OUTSIDE = re.compile("[\x1c-\x1f\x85ɐ-‒‧-\U0010ffff]")

_WORKER: dict[tuple, Counter] = {}


class Counter(dict):
    """Pre-token -> number of tokens, for one tokenizer file: the broadcast table, then the bounded cache."""

    def __init__(self, path: str, table: dict[str, int], bound: int = CACHE_ENTRIES):
        self.library = Tokenizer.from_file(path)
        self.table, self.bound = table, bound
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        super().__init__(table)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.bound + len(self.table):
            self.clear()
            self.update(self.table)
        n = self[piece] = len(self.library.encode(piece, add_special_tokens=False).ids)
        return n

    def pieces(self, text: str) -> list[str]:
        if not OUTSIDE.search(text):
            return PRE_TOKENS.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts if part) + len(parts) - 1


def frequent_lengths(
    docs: DataFrame, path: str, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES
) -> dict[str, int]:
    """The most frequent pre-tokens of about ``sample_docs`` documents (picked by text hash), with token counts.

    Only ``entries`` pairs reach the driver and are broadcast: a fixed bound of a few MB whatever the corpus.
    """
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Counter(path, {})
        for texts in batches:
            yield pd.Series([[x for x in own.pieces(t) if len(x) <= 40] for t in texts])

    text = F.col(f"`{text_col}`")
    every = max(1, docs.count() // sample_docs)
    picked = (
        docs.where(text.isNotNull() & (F.pmod(F.xxhash64(text), F.lit(every)) == 0) & (F.length(text) <= 100_000))
        .select(text.alias("t"))
        .limit(2 * sample_docs)
    )
    top = (
        picked.select(F.explode(cut("t")).alias("p")).groupBy("p").count().orderBy(F.desc("count"), "p").limit(entries)
    )
    own = Counter(path, {})
    words = [r["p"] for r in top.select("p").collect()]
    return dict(zip(words, (len(e.ids) for e in own.library.encode_batch(words, add_special_tokens=False))))


def token_count_column(docs: DataFrame, text: Column, path: str, table: dict[str, int]) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (path, id(shared) if shared is None else len(shared.value))
        own = _WORKER.get(key)
        if own is None or own.table != shared.value:
            _WORKER.clear()
            own = _WORKER[key] = Counter(path, shared.value)
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts], dtype="int64")

    return counted(F.coalesce(text.cast("string"), F.lit("")))


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` in a struct column ``tokens`` of its own.

    Null and empty texts count zero. Special strings inside a text count one token each, as the library does by
    default. Repeated rows give repeated results. ``path`` is the tokenizer file, readable on every executor.
    """
    arrow_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    table = frequent_lengths(docs, path, text_col)
    n = token_count_column(docs, text, path, table)
    row = [F.col(f"`{c}`") for c in docs.columns if c != "tokens"]
    out = docs.select(*row, F.struct(F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), n.alias("n_tokens")).alias("tokens"))
    return out.withColumn("tokens", F.col("tokens").withField("over_limit", F.col("tokens.n_tokens") > limit))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "tokens.*")
