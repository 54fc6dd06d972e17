"""BPE encoding and decoding with batched numpy merge rounds.

Follows a published tokenizer file: added special tokens are found in the raw text, the rest is put in NFC,
white space runs become one space, letters become lower case, words are cut by a pattern, their UTF-8 bytes
are the first symbols (the last one marked as a word end), and the lowest-ranked pair merges first.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_pieces, ranges

#: The white space of the file's patterns (control characters 1C to 1F are none).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Words of many chunks and the spaces between these.
MARKED = regex.compile(f"{WORDS.pattern}| ")
NONE = np.iinfo(np.int64).max
#: Distinct chunks of text that a task keeps at once, and their bytes with what they encode to.
CACHE, CACHE_BYTES = 200_000, 64 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def folded(text: str) -> str:
    """NFC, then lower case. White space stays as it is: no word has any."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Bpe:
    """Tables of a tokenizer file; small (a few MB), so it goes to the tasks with the function."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.width = max(self.tokens) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.pair_ids = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], dtype=np.int64)
        if any("<" not in t or " " in t for t in self.special):
            raise ValueError("special tokens must have a < and no space, by which chunks that may hold one are known")
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all (non-empty) words in one array, and the count for each word.

        A round finds the rank of every adjacent pair by binary search over the sorted pair keys, takes each
        word's lowest, and merges its places from the left. Words without a pair leave.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_words, done_symbols = [], []
        while len(symbols):
            ranks = np.full(len(symbols), NONE)
            keys = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            hit = np.flatnonzero((self.pair_keys[at] == keys) & (word[:-1] == word[1:]))
            ranks[hit] = self.pair_ranks[at[hit]]
            first = np.concatenate(([True], word[1:] != word[:-1]))
            nth = np.cumsum(first) - 1
            lowest = np.minimum.reduceat(ranks, np.flatnonzero(first))[nth]
            over = lowest == NONE
            if over.any():
                done_words.append(word[over])
                done_symbols.append(symbols[over])
            place = np.flatnonzero((ranks == lowest) & ~over)
            if len(place):
                # Places that follow one another (a pair of equal symbols) overlap: every other one merges.
                run = np.concatenate(([True], (np.diff(place) > 1) | (np.diff(word[place]) > 0)))
                start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - start) % 2 == 0]
                symbols[place] = self.pair_ids[at[place]]
            keep = ~over
            keep[place + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return np.zeros(0, dtype=np.int64), lengths
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def words(self, chunk: str) -> list[str | int]:
        """The words of a chunk, special tokens as ids."""
        out: list[str | int] = []
        for part in self.split_special.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += WORDS.findall(folded(part))
        return out

    def cut(self, chunks: list[str]) -> list[list[str | int]]:
        """The words of each chunk. Those without a space or < go together, with spaces between, over which neither
        normalisation nor the pattern reaches."""
        plain = [c for c in chunks if "<" not in c and " " not in c]
        found = MARKED.findall(folded(" ".join(plain)))
        marks = [-1, *(i for i, w in enumerate(found) if w == " "), len(found)]
        lists = iter([found[a + 1 : b] for a, b in zip(marks, marks[1:])])
        return [self.words(c) if "<" in c or " " in c else next(lists) for c in chunks]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all chunks in one array, and the bounds of each chunk's (one more than chunks)."""
        cut = self.cut(chunks)
        flat = list(chain.from_iterable(cut))
        special = np.array(list(self.special.values()), dtype=np.int64)
        # Special tokens stand behind the words: counted from the end.
        number: dict[str | int, int] = {t: i - len(special) for i, t in enumerate(special.tolist())}
        new = [w for w in dict.fromkeys(flat) if w not in number]
        number.update(zip(new, range(len(new))))
        ids, counts = self.merge([w.encode() for w in new])
        ids, counts = np.concatenate((ids, special)), np.concatenate((counts, np.ones(len(special), dtype=np.int64)))
        at = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = counts[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        return ids[ranges((np.cumsum(counts) - counts)[at], n)], upto[np.cumsum([0, *map(len, cut)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_chunks([text])[0].tolist()

    def decode(self, ids) -> str:
        """The tokens with a space between: what a file without a decoder gives. Unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def bpe_encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True
) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and where asked for ids and decoded.

    ids_sha256 is over the ids as little-endian 32-bit numbers, decoded_sha256 over the decoded text in UTF-8.
    Row by row, without a shuffle. A text is cut at spaces into chunks, which cannot share a word, so each
    distinct chunk is encoded once in a task (a bounded cache); new ones go through the merge rounds together.
    A null text counts as empty (no tokens). Repeated rows give repeated rows, an empty table none. Ids are numbers (a
    null stays null). Other columns, whatever their names, don't matter.
    """
    bpe = Bpe(path)
    extra = [("ids", "array<int>")] * ids + [("decoded", "string")] * decoded
    schema = ", ".join(
        ["doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", *(f"{n} {t}" for n, t in extra)]
    )

    def make():
        cache: dict[str, tuple[bytes, str]] = {}
        held = 0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal held
            if len(cache) > CACHE or held > CACHE_BYTES:
                cache.clear()
                held = 0
            texts = [(t or "").split(" ") for t in batch.column("_text").to_pylist()]
            new = list(set().union(*texts) - cache.keys())
            tokens, bounds = bpe.encode_chunks(new)
            tokens, names, bounds = tokens.astype("<u4").tobytes(), list(map(bpe.tokens.__getitem__, tokens.tolist())), bounds.tolist()
            for chunk, a, b in zip(new, bounds, bounds[1:]):
                cache[chunk] = (tokens[4 * a : 4 * b], text := " ".join(names[a:b]))
                held += len(chunk) + 4 * (b - a) + len(text)
            found = [[cache[c] for c in chunks] for chunks in texts]
            raw = [b"".join([f[0] for f in doc]) for doc in found]
            text = [" ".join([f[1] for f in doc if f[0]]) for doc in found]
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in raw], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text], pa.string()),
            ]
            if ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            if decoded:
                columns.append(pa.array(text, pa.string()))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(n for n, _ in extra)]
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return map_pieces(rows, "_text", make, schema)
