"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily into
the longest phrases that occur in the sample; the number of phrases, times the bits that name a place in the sample,
over the number of letters, estimates the cross entropy. The language that needs the fewest such bits wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.runtime import arrow_batches

SAMPLE_CHARS = 30_000  # per language
SAMPLE_DOCS = 200  # documents that a language's sample is taken from, at most
BLOCK = 256  # characters that are parsed side by side with other blocks
GROUP = 4096  # blocks in memory at a time
PIECE = 1 << 18  # characters of a text that are made code points at a time
_WORKER: dict[tuple, list] = {}


LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def pieces(text: str) -> Iterator[np.ndarray]:
    """Lower-cased code points with every run of non-letters as one space, a bounded piece at a time."""
    low, after_letter = text.lower(), False
    for at in range(0, len(low), PIECE):
        codes = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        small = codes < len(LETTER)
        letter = small & LETTER[np.where(small, codes, 0)]
        for i in np.nonzero(~small)[0].tolist():
            letter[i] = chr(codes[i]).isalpha()
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        yield np.where(letter, codes, 32)[keep]


def normalise(text: str) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int32), *pieces(text)])


class Automaton:
    """Suffix automaton of one sample. Its moves share one array: state ``s`` has symbol ``c`` at ``base[s] + c`` if
    ``owner`` says so there. Rows are fitted into each other's gaps, so memory follows the sample, not its alphabet."""

    def __init__(self, sample: np.ndarray):
        self.alphabet, coded = np.unique(sample, return_inverse=True)
        self.bits = float(np.log2(max(2, len(sample))))
        rows: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in coded.tolist():
            new = len(rows)
            rows.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in rows[p]:
                rows[p][c] = new
                p = link[p]
            if p >= 0:
                q = rows[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(rows)
                    rows.append(dict(rows[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and rows[p].get(c) == q:
                        rows[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self._pack(rows)

    def _pack(self, rows: list[dict[int, int]]) -> None:
        """Rows of two and more moves go, longest first, to a random place where they fit; single moves fill the gaps."""
        width, edges = len(self.alphabet) + 1, sum(map(len, rows))  # the last symbol is in no sample
        rng, end = np.random.default_rng(7), width
        self.base = np.full(len(rows), width, np.int32)
        self.owner, self.to = np.full(4 * edges + 4 * width, -1, np.int32), np.zeros(4 * edges + 4 * width, np.int32)
        sizes = np.array([len(r) for r in rows])
        for state in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            symbols = np.fromiter(rows[state], np.int64, len(rows[state]))
            tries = np.sort(rng.integers(0, end, 128))
            fits = (self.owner[tries[:, None] + symbols] < 0).all(axis=1)
            at = int(tries[fits.argmax()]) if fits.any() else end
            places = at + symbols
            end = max(end, int(places.max()) + 1)
            if end + 2 * width > len(self.owner):
                self.owner = np.concatenate([self.owner, np.full(len(self.owner), -1, np.int32)])
                self.to = np.concatenate([self.to, np.zeros(len(self.to), np.int32)])
            self.base[state], self.owner[places], self.to[places] = at, state, list(rows[state].values())
        singles = np.nonzero(sizes == 1)[0]
        gaps = width + np.nonzero(self.owner[width:] < 0)[0][: len(singles)]
        if len(gaps) < len(singles):
            more = np.arange(len(self.owner), len(self.owner) + len(singles) - len(gaps))
            gaps = np.concatenate([gaps, more])
        end = max(end, int(gaps[-1]) + 1 if len(gaps) else 0) + width
        grown = max(0, end - len(self.owner))
        self.owner = np.concatenate([self.owner, np.full(grown, -1, np.int32)])[:end].copy()
        self.to = np.concatenate([self.to, np.zeros(grown, np.int32)])[:end].copy()
        only = [next(iter(rows[s].items())) for s in singles.tolist()]
        self.base[singles] = gaps - np.array([c for c, _ in only], np.int64)
        self.owner[gaps], self.to[gaps] = singles, [t for _, t in only]
        self.first = np.zeros(width, np.int32)  # the root's moves; 0 where it has none
        self.first[list(rows[0])] = list(rows[0].values())

    def coded(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, codes).astype(np.int32)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == codes, at, np.int32(len(self.alphabet))) if len(self.alphabet) else at

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase starts; a symbol of no sample is one of its own."""
        place = self.base[state] + c
        goes = self.owner[place] == state
        return np.where(goes, self.to[place], self.first[c]), ~goes | (state == 0)

    def phrases(self, blocks: np.ndarray, lengths: np.ndarray, follows: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Phrases that start in each row of ``blocks`` and the last row's state, as if rows that follow were one text.

        All rows are parsed from the root side by side. A row that ``follows`` the one before it is then parsed again
        from that one's last state, only until both parses start a phrase at one place: from there on they agree.
        Where they never do, the row's last state changes and the row after it is parsed again.
        """
        order = np.argsort(-lengths, kind="stable")
        sorted_codes = np.ascontiguousarray(self.coded(blocks[order].T.ravel()).reshape(blocks.shape[::-1]))
        live = np.searchsorted(-lengths[order], -np.arange(blocks.shape[1]), side="left")
        state, begun = np.zeros(len(blocks), np.int32), np.zeros(sorted_codes.shape, bool)
        for j, n in enumerate(live.tolist()):
            state[:n], begun[j, :n] = self.step(state[:n], sorted_codes[j, :n])
        exits, back = np.empty_like(state), np.argsort(order, kind="stable")
        exits[order] = state
        coded, starts = sorted_codes[:, back], begun[:, back]
        todo, used = np.nonzero(follows)[0], np.zeros(len(blocks), np.int32)
        while len(todo):
            given = np.where(todo > 0, exits[todo - 1], entry).astype(np.int32)
            fresh = given != used[todo]
            on, state, changed = todo[fresh], given[fresh], []
            used[on] = state
            for j in range(len(coded) + 1):
                done = lengths[on] <= j
                if done.any():
                    changed.append(on[done][exits[on[done]] != state[done]])
                    exits[on[done]] = state[done]
                    on, state = on[~done], state[~done]
                if not len(on):
                    break
                state, now = self.step(state, coded[j, on])
                met = now & starts[j, on]
                starts[j, on] = now
                on, state = on[~met], state[~met]
            after = np.concatenate([np.empty(0, np.int64), *changed]).astype(np.int64) + 1
            after = after[after < len(blocks)]
            todo = np.sort(after[follows[after]])
        return starts.sum(axis=0), int(exits[-1])


def entropies(texts: list[str], models: list[Automaton]) -> np.ndarray:
    """Bits a letter for each text and model; texts without letters get infinity.

    Blocks are gathered up to ``GROUP`` of them, whatever the texts' lengths; a text that goes on in the next group
    takes its states with it.
    """
    sizes, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(models)))
    held: list[tuple[int, bool, np.ndarray]] = []  # text, whether it goes on from the block before, code points
    states = [0] * len(models)

    def parse() -> None:
        if not held:
            return
        lengths = np.array([len(x) for _, _, x in held])
        blocks = np.full((len(held), int(lengths.max())), -1, np.int32)
        for row, (_, _, x) in enumerate(held):
            blocks[row, : len(x)] = x
        owner, follows = np.array([i for i, _, _ in held]), np.array([f for _, f, _ in held])
        for m, model in enumerate(models):
            count, states[m] = model.phrases(blocks, lengths, follows, states[m])
            total[:, m] += np.bincount(owner, count, len(texts))
        held.clear()

    for i, t in enumerate(texts):
        for codes in pieces(t):
            for at in range(0, len(codes), BLOCK):
                part = codes[at : at + BLOCK]
                held.append((i, sizes[i] > 0, part))
                sizes[i] += len(part)
                if len(held) == GROUP:
                    parse()
    parse()
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sizes[:, None] > 0, total * np.array([m.bits for m in models]) / sizes[:, None], np.inf)


def learn_samples(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", chars: int = SAMPLE_CHARS
) -> dict[str, str]:
    """Language -> sample of at most ``chars`` characters, from documents in the order of their text's hash.

    Each document gives one passage of at most ``chars / 50`` characters, placed by the hash, so a sample has many
    documents. What reaches the driver is ``chars`` characters a language at most.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    size, h = chars // 50, F.xxhash64(text)
    place = F.pmod(h, F.greatest(F.length(text) - size, F.lit(1)).cast("long")).cast("int") + 1
    rows = labelled.where(lang.isNotNull() & text.isNotNull()).select(
        lang.alias("lang"), text.substr(place, F.lit(size)).alias("t"), h.alias("h")
    )
    # a partial top-k per task and language, then the same once more: no language's rows meet in one task
    some = Window.partitionBy("lang", "salt").orderBy("h")
    once = rows.withColumn("salt", F.pmod("h", F.lit(64)))
    kept = once.withColumn("r", F.row_number().over(some)).where(F.col("r") <= SAMPLE_DOCS).drop("r", "salt")
    last = Window.partitionBy("lang").orderBy("h", "t")
    got = kept.withColumn("r", F.row_number().over(last)).where(F.col("r") <= SAMPLE_DOCS).select("lang", "r", "t").collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["r"])):
        samples.setdefault(r["lang"], []).append(r["t"])
    return {k: " ".join(v)[:chars] for k, v in samples.items()}


def _models(samples: dict[str, str]) -> list[Automaton]:
    key = tuple(sorted((k, hash(v)) for k, v in samples.items()))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = [Automaton(normalise(samples[k])) for k in sorted(samples)]
    return _WORKER[key]


def predict(texts: list[str | None], samples: dict[str, str]) -> list[tuple[str, float]]:
    names, models = sorted(samples), _models(samples)
    if not models:
        return [("und", 0.0)] * len(texts)
    bits = entropies([t or "" for t in texts], models)
    out = []
    for row in bits:
        if not np.isfinite(row).any():
            out.append(("und", 0.0))
            continue
        best = int(row.argmin())
        share = np.exp2(-4.0 * (row - row[best]))
        out.append((names[best], float(1.0 / share.sum())))
    return out


def language_column(text: Column, samples: dict[str, str], spark) -> Column:
    """Struct ``(lang_pred, score)``; null, empty and letterless texts give ``und`` and 0."""
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(samples)

    @F.pandas_udf("lang_pred string, score double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(predict(list(texts), shared.value), columns=["lang_pred", "score"])

    return found(text)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    samples = learn_samples(docs.where(~held))
    out = docs.select("doc_id", held.alias("held_out"), language_column(F.col("text"), samples, spark).alias("p"))
    return out.select("doc_id", "held_out", "p.*")
