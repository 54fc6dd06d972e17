"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_pieces, pieces

ORDER = 4
DISCOUNT = 0.75
#: Symbols that the last, uniform distribution is spread over.
ALPHABET = 10_000
UNDETERMINED = "und"
SPACE = 32
#: Bytes of text scored at once; some forty bytes of arrays stand for each.
PIECE = 1 << 18

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or SPACE if it is no letter; made once in a process."""
    if not _letters:
        out = np.full(sys.maxunicode + 1, SPACE, dtype=np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _letters.append(out)
    return _letters[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, at, doc): texts as letters with one space between words, padded for the model's context.

    at are the places in codes that are predicted, doc the text of each.
    """
    framed = [f" {t} " for t in texts]
    raw = b"".join(t.encode("utf-32-le", "surrogatepass") for t in framed)
    codes = letters()[np.frombuffer(raw, dtype="<u4")]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in framed])
    blank = codes == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1] | (doc[1:] != doc[:-1])
    keep[:1] = True
    codes, doc = codes[keep], doc[keep]
    at = np.arange(len(codes)) + (ORDER - 1) * (doc + 1)
    out = np.full(len(codes) + (ORDER - 1) * len(texts), SPACE, dtype=np.uint32)
    out[at] = codes
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    return out, at[~first], doc[~first]


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """[0]: zeros; [n]: the hash of the n symbols that end at each place (wrong at the first n - 1 places)."""
    out = [np.zeros(len(codes), dtype=np.uint64)]
    c = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, ORDER + 1):
        before = np.roll(out[-1], 1)
        h = (before ^ c) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
        out.append(h ^ (h >> np.uint64(32)))
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, n, gram, context, suffix, n_seen): counts within a piece."""
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            langs = np.array(piece.column("lang").to_pylist(), dtype=object)
            texts = piece.column("text").to_pylist()
            for lang in set(langs):
                codes, at, _ = symbols([texts[i] for i in np.flatnonzero(langs == lang)])
                hashes = gram_hashes(codes)
                for n in range(1, ORDER + 1):
                    grams, first, counts = np.unique(hashes[n][at], return_index=True, return_counts=True)
                    where = at[first]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), n, dtype=np.int32)),
                            pa.array(grams.view(np.int64)), pa.array(hashes[n - 1][where - 1].view(np.int64)),
                            pa.array(hashes[n - 1][where].view(np.int64)), pa.array(counts.astype(np.int64)),
                        ],
                        ["lang", "n", "gram", "context", "suffix", "n_seen"],
                    )


@dataclass
class Models:
    """For each order: sorted n-gram hashes with a row of log probabilities, one for each language, fully
    interpolated; and sorted context hashes with the log weight that is left to the order below."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    #: For each language: mean of the cross-entropy of labelled texts, and its variance: base + per symbol / length.
    mean: np.ndarray
    spread: np.ndarray

    def log_probabilities(self, hashes: list[np.ndarray], at: np.ndarray, n: int = ORDER) -> np.ndarray:
        """(places, languages); only places whose n-gram no language has seen go on to the order below."""
        if n == 0:
            return np.full((len(at), len(self.langs)), -np.log(ALPHABET), dtype=np.float32)
        keys, values = self.grams[n - 1]
        grams = hashes[n][at]
        found = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out = values[found]
        miss = np.flatnonzero(keys[found] != grams)
        if len(miss):
            keys, values = self.contexts[n - 1]
            context = hashes[n - 1][at[miss] - 1]
            found = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            left = np.where((keys[found] == context)[:, None], values[found], np.float32(0))
            out[miss] = left + self.log_probabilities(hashes, at[miss], n - 1)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a symbol, (texts, languages), and each text's symbols (0: no letter)."""
        codes, at, doc = symbols(texts)
        length = np.bincount(doc, minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        if len(at):
            p = self.log_probabilities(gram_hashes(codes), at)
            have = np.flatnonzero(length)
            total[have] = np.add.reduceat(p, (np.cumsum(length) - length)[have], axis=0, dtype=np.float64)
        return -total / np.maximum(length, 1)[:, None], length

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index or -1, score, whether rejected).

        score is the share of the best language among all at a sharpened likelihood, times how well the text
        fits it: 1 within 3 standard deviations of labelled texts of its length, then falling. A text further
        than 8 deviations off is rejected, as is one without letters.
        """
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        entropy, length = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        share = 1 / np.exp(-(entropy - low[:, None]) * np.minimum(length, 200)[:, None]).sum(axis=1)
        sd = np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(length, 1))
        off = (low - self.mean[best]) / sd
        score = share * np.exp(-np.maximum(0, off - 3) / 5)
        none = length == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), none | (off > 8)


def interpolated(langs: list[str], counts: dict[int, tuple[np.ndarray, ...]]) -> tuple[list, list]:
    """Sorted tables from counts[n] = (language, gram, context, suffix, seen), by interpolated Kneser-Ney.

    Orders below the highest count distinct left extensions instead of occurrences.
    """
    grams, contexts = [], []
    lower_keys, lower = np.zeros(1, dtype=np.uint64), np.full((1, len(langs)), 1 / ALPHABET)
    for n in range(1, ORDER + 1):
        lang, gram, context, suffix, seen = counts[n]
        keys, first, gram_at = np.unique(gram, return_index=True, return_inverse=True)
        context_keys, context_at = np.unique(context, return_inverse=True)
        c = np.zeros((len(keys), len(langs)))
        if n == ORDER:
            c[gram_at, lang] = seen
        else:
            up_lang, _, _, up_suffix, _ = counts[n + 1]
            np.add.at(c, (np.searchsorted(keys, up_suffix), up_lang), 1)
        context_of = context_at[first]
        total, kinds = np.zeros((len(context_keys), len(langs))), np.zeros((len(context_keys), len(langs)))
        np.add.at(total, context_of, c)
        np.add.at(kinds, context_of, c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
            own = np.where(total[context_of] > 0, np.maximum(c - DISCOUNT, 0) / total[context_of], 0.0)
        below = lower[np.searchsorted(lower_keys, suffix[first])]
        lower_keys, lower = keys, own + left[context_of] * below
        grams.append((keys, np.log(lower).astype(np.float32)))
        contexts.append((context_keys, np.log(left).astype(np.float32)))
    return grams, contexts


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text has remainder 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(
    docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", rows_per_lang: int = 1500, folds: int = 5, seed: int = 7,
    bytes_per_lang: int = 16 << 20,
) -> Models:
    """Models from a bounded sample: about rows_per_lang labelled rows of each language outside the held-out fold.

    The rows are those of the smallest seeded hashes of the id, whole; fewer where their texts are so long that the
    language would pass bytes_per_lang (about), so the n-gram tables are bounded too. A sixth of them is kept apart
    and calibrates rejection. Counting runs on the executors; only distinct n-grams of the sample reach the driver.
    Rows without an id, a text or a language are not learned from. Ties in the hash stay or go together.
    """
    known = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"), folds))
    known_sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    sizes = {r["lang"]: max(r["n"], rows_per_lang * (r["bytes"] or 0) / bytes_per_lang) for r in known_sizes}
    langs = sorted(sizes)
    if not langs:
        return Models([], [], [], np.zeros(0), np.zeros((0, 2)))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003))
    below = F.create_map(*[F.lit(x) for k in langs for x in (k, int(1_000_003 * min(1.0, rows_per_lang / sizes[k])) + 1)])
    sample = known.filter("text IS NOT NULL").withColumn("draw", draw).filter(F.col("draw") < below[F.col("lang")])
    train, apart = sample.filter("draw % 6 <> 0"), sample.filter("draw % 6 = 0")
    counted = (
        train.select("lang", "text")
        .mapInArrow(count_grams, "lang string, n int, gram bigint, context bigint, suffix bigint, n_seen bigint")
        .groupBy("lang", "n", "gram", "context", "suffix")
        .agg(F.sum("n_seen").alias("n_seen"))
        .toArrow()
    )
    column = lambda name: counted.column(name).to_numpy()
    lang, order = np.searchsorted(langs, counted.column("lang").to_pylist()) if len(counted) else np.zeros(0, int), column("n")
    table = (lang, *(column(c).view(np.uint64) for c in ("gram", "context", "suffix")), column("n_seen"))
    if not len(order):
        return Models([], [], [], np.zeros(0), np.zeros((0, 2)))
    grams, contexts = interpolated(langs, {n: tuple(c[order == n] for c in table) for n in range(1, ORDER + 1)})
    models = Models(langs, grams, contexts, np.zeros(len(langs)), np.ones((len(langs), 2)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                entropy, length = models.entropies(piece.column("text").to_pylist())
                number = np.searchsorted(models.langs, piece.column("lang").to_pylist())
                own = entropy[np.arange(len(number)), number]
                yield pa.RecordBatch.from_arrays([piece.column("lang"), pa.array(own), pa.array(length)], ["lang", "h", "n"])

    fits = apart.select("lang", "text").mapInArrow(measure, "lang string, h double, n bigint").filter("n > 0")
    mean = {r["lang"]: r["m"] for r in fits.groupBy("lang").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    models.mean = np.array([mean.get(k, 3.0) for k in langs])
    centre = F.create_map(*[F.lit(x) for k, m in zip(langs, models.mean.tolist()) for x in (k, m)])
    square = (F.col("h") - centre[F.col("lang")]) ** 2
    rows = fits.groupBy("lang").agg(
        F.avg(F.when(F.col("n") >= 1000, square)).alias("base"), F.avg(square * F.col("n")).alias("per_symbol")
    )
    spread = {r["lang"]: (r["base"] or 0.01, r["per_symbol"]) for r in rows.collect()}
    models.spread = np.array([[max(1e-4, x) for x in spread.get(k, (0.01, 5.0))] for k in langs])
    return models


def identify(docs: DataFrame, models: Models, id_col="doc_id", text_col="text", folds: int = 5) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score, rejected.

    Row by row over whole texts, without a shuffle. A text that is null or has no letter is `und` with score 0
    and rejected; with no learned language all are. Repeated rows give repeated rows, an empty table none. Ids are
    numbers; a null id is not held out. Of languages that fit a text alike the first by name is taken. Other columns,
    whatever their names, don't matter.
    """
    langs = np.array([*models.langs, UNDETERMINED], dtype=object)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            best, score, rejected = models.judge([t or "" for t in batch.column("_text").to_pylist()])
            columns = [
                batch.column("doc_id"), batch.column("held_out"), pa.array(langs[best], pa.string()),
                pa.array(score), pa.array(rejected),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

        return each

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col).alias("_text")
    )
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"
    return map_pieces(rows, "_text", make, schema, PIECE)


def accepted(docs: DataFrame, models: Models, text_col="text") -> DataFrame:
    """docs without the rows that identify() rejects; same columns, whatever their names.

    A null text, an empty one or one without letters is rejected, and all are if no language was learned. Repeated
    rows are judged alike; an empty table gives no rows.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col, PIECE):
                rejected = models.judge([t or "" for t in piece.column(text_col).to_pylist()])[2]
                yield piece.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)
