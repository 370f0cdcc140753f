"""Lexical retrieval packing: windows of at most ``window`` tokens filled with a seed's BM25 neighbours.

Documents become token ids, each ended by ``end_id``. A document's full windows stand alone; the rest (shorter than a
window) is packed. Rows are dealt to shards of about ``shard_rows`` by a hash of id and text, so that shards don't depend on how files
are split; each has an inverted index from words (lower-cased runs of letters, and digits, hashed into ``TERMS`` cells) to its documents. The longest unused
rest seeds a window; its BM25 scores, by all its words, against all unused rests of the shard rank the neighbours, which fill the window greedily: the best one
that fits whole, until none fits, and then the best one cut to the room that is left, whose remainder seeds the next
window. So every window is full but the last of a shard. Document frequencies and the mean length for BM25 are counted
over all documents (a table of ``TERMS`` numbers).

A shard that grows beyond ``2 * shard_rows`` rows or ``shard_tokens`` tokens (many rows of one id and text, very long texts) is packed in parts of
that size, so memory is bounded by that and the longest text. Ranks tie by the order of id, then CRC-32 of the text. Null and empty texts are the end id alone; repeated rows and ids are packed
row by row; very long texts are cut into windows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, shingles

WINDOW = 2048
END_ID = 1
TERM_BITS = 18
TERMS = 1 << TERM_BITS
SHARD_ROWS = 1536
SHARD_TOKENS = 1 << 21
#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
#: Pieces kept in a worker's cache; new ones encoded at once; documents encoded at once.
CACHE, LINE, CHUNK = 1_000_000, 500, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import sys

    if "/opt/tokenizers" not in sys.path:
        sys.path.append("/opt/tokenizers")
    try:
        import public_tokenizers
    except ImportError:
        import importlib.util

        spec = importlib.util.spec_from_file_location("public_tokenizers", "/opt/tokenizers/__init__.py")
        public_tokenizers = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(public_tokenizers)
    return public_tokenizers.path("word_bpe_49k.json")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder, so that its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


#: Kinds of bytes: white space, letters, digits, other signs, and those that need the whole word to be looked at. Fixed values of ASCII and Latin-1.
SPACE, LETTER, DIGIT, SIGN, HARD = 0, 1, 2, 3, 5
_KIND = np.full(256, HARD, np.uint8)
_KIND[:128] = SIGN
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
_KIND[48:58] = DIGIT
_KIND[39] = HARD  # an apostrophe may start a contraction
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(texts: list[bytes]):
    """Runs of letters, digits and runs of signs of the texts (joined by a line end): their hashes with letters lower-cased, starts, ends, per
    text the number of its first one, which are no signs, and the joined texts. Letters are those of ASCII and Latin-1; a
    word with anything else, an apostrophe or the start of a special token is one piece as it stands."""
    whole = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(whole, np.uint8)
    kind, low = _KIND[raw], _LOWER[raw]
    latin = np.nonzero(raw[:-1] == 0xC3)[0] + 1
    if latin.size:
        second = raw[latin]
        sign = (second == 0x97) | (second == 0xB7)
        kind[latin] = np.where(sign, HARD, LETTER)
        low[latin] = np.where((second <= 0x9E) & ~sign, second + 32, second)
    if b"<|" in whole:
        kind[np.nonzero((raw[:-1] == 60) & (raw[1:] == 124))[0]] = HARD
    hard = np.nonzero(kind == HARD)[0]
    if hard.size:
        edge = np.diff((kind == SPACE).view(np.int8), prepend=1)
        starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        word = np.unique(np.searchsorted(starts, hard, "right") - 1)
        size = ends[word] - starts[word]
        at = np.arange(size.sum()) + np.repeat(starts[word] - (np.cumsum(size) - size), size)
        kind[at], low[at] = HARD, raw[at]
    change = kind[1:] != kind[:-1]
    change |= kind[1:] == DIGIT
    begin = np.concatenate(([True], change)) & (kind != SPACE)
    end = np.concatenate((change, [True])) & (kind != SPACE)
    end[:-1] |= (kind[:-1] == DIGIT) & (kind[1:] != SPACE)
    starts, ends = np.nonzero(begin)[0], np.nonzero(end)[0] + 1
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return shingles.hashes(low, starts, ends), starts, ends, np.searchsorted(starts, bounds), kind[starts] != SIGN, whole


class WordEncoder:
    """Token ids of whole texts for a vocabulary that lower-cases, splits words into letters, digits and signs, and never
    joins pieces: pieces are looked up by 64 bits of hash, and only new ones are encoded. The table has two places for a piece, and a newer one takes an older one's."""

    SLOTS = 21

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        tree = json.loads(self.of.to_str())
        self.cut = regex.compile(tree["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in tree["added_tokens"]) or "(?!)")
        vocab = self.of.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        self.known = self.held = 0
        self.keys, self.rows = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int32)
        self.ids_of = np.zeros(1 << 16, np.int32)  # the pieces' ids, one after the other
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _pieces(self, word: str) -> int:
        """How many pieces the tokenizer cuts one of ours without special tokens into."""
        if word.isascii() and "'" not in word:
            return 1
        return len(self.cut("".join(c.lower() for c in unicodedata.normalize("NFC", word))))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and how many each has."""
        odd = [i for i, w in enumerate(words) if "<|" in w]
        plain = [w for i, w in enumerate(words) if i not in set(odd)] if odd else words
        flat, size = np.zeros(0, np.int32), np.zeros(len(plain), np.int64)
        if plain:  # a piece's last token is marked as a word's end, which cuts the ids of a line into those of its words
            lines = [" ".join(plain[at : at + LINE]) for at in range(0, len(plain), LINE)]
            flat = np.concatenate([np.array(e.ids, np.int32) for e in self.of.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.concatenate(([0], np.nonzero(self.final[flat])[0] + 1))
            size = np.diff(ends[np.cumsum([0, *map(self._pieces, plain)])])
        if odd:
            parts, sizes, at, k = [], np.zeros(len(words), np.int64), 0, 0
            for i, w in enumerate(words):
                if k < len(odd) and odd[k] == i:
                    parts.append(np.array(self.of.encode(w, add_special_tokens=False).ids, np.int32))
                    k += 1
                else:
                    n = size[i - k]
                    parts.append(flat[at : at + n])
                    at += n
                sizes[i] = parts[-1].size
            flat, size = np.concatenate(parts), sizes
        return flat, size

    def _add(self, keys: np.ndarray, words: list[str]):
        flat, size = self._encode(words)
        n, begin = self.known, self.held
        while self.ids_of.size < begin + flat.size:
            self.ids_of = np.concatenate((self.ids_of, np.zeros_like(self.ids_of)))
        while self.begin.size < n + len(keys):
            self.begin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size))
        self.ids_of[begin : begin + flat.size] = flat
        self.held += flat.size
        self.begin[n : n + len(keys)] = begin + np.cumsum(size) - size
        self.size[n : n + len(keys)] = size
        self.known += len(keys)
        a, b = self._slots(keys)
        slot = np.where(self.keys[a] == 0, a, b)
        self.keys[slot] = keys
        self.rows[slot] = np.arange(n, n + len(keys))
        lost = np.nonzero(self.keys[slot] != keys)[0]  # of new ones with the same place the last has it
        self.rows[slot[lost]] = np.int32(-1)
        self.keys[slot[lost]] = 0

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - self.SLOTS)).astype(np.int64), (h & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64)

    def encoded(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """int32 ids of each text, and the cells of its pieces."""
        if self.known > CACHE:
            self._clear()
        h, starts, ends, first, term, whole = pieces(texts)
        a, b = self._slots(h)
        row = np.where(self.keys[a] == h, self.rows[a], np.where(self.keys[b] == h, self.rows[b], np.int32(-1))).astype(np.int64)
        miss = np.nonzero(row < 0)[0]
        if miss.size:
            key, at, which = np.unique(h[miss], return_index=True, return_inverse=True)
            row[miss] = self.known + which
            at = miss[at]
            self._add(key, [whole[x:y].decode() for x, y in zip(starts[at].tolist(), ends[at].tolist())])
        size = self.size[row]
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids_of[np.arange(upto[-1]) + np.repeat(self.begin[row] - upto[:-1], size)]
        cut = upto[first].tolist()
        return [flat[c:d] for c, d in zip(cut, cut[1:])], _cells(h, first, term)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoded([x.encode() for x in texts])[0]


def _cells(h: np.ndarray, first: np.ndarray, term: np.ndarray) -> list[np.ndarray]:
    """The cells of each text's pieces but signs, in order."""
    cells = (h[term] >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(term)))[first].tolist()
    return [cells[a:b] for a, b in zip(at, at[1:])]


def _terms(texts: list[bytes]) -> list[np.ndarray]:
    h, _, _, first, term, _ = pieces(texts)
    return _cells(h, first, term)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, documents and words, over the whole table."""

    def run(batches):
        df, n, total = np.zeros(TERMS, np.int64), 0, 0
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                terms = _terms([x or b"" for x in b.column(1).slice(at, CHUNK).to_pylist()])
                n += len(terms)
                total += sum(map(len, terms))
                own = np.concatenate([t + (i << TERM_BITS) for i, t in enumerate(terms)]) if terms else np.zeros(0, np.int64)
                own.sort()
                df += np.bincount(own[np.diff(own, prepend=-1) != 0] & (TERMS - 1), minlength=TERMS)
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, total]))], ["term", "df"])

    rows = docs.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df, got = np.zeros(TERMS, np.int64), rows[rows["term"] >= 0]
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    ends = dict(zip(rows["term"], rows["df"]))
    return df, int(ends.get(-1, 0)), int(ends.get(-2, 0))


def pack_shard(size: np.ndarray, terms: list[np.ndarray], idf: np.ndarray, mean: float, window: int):
    """Windows of (rest, from, to), in order; every token of every rest lies in exactly one. ``size`` has the rests' tokens,
    all shorter than the window, ``terms`` the words of their documents."""
    n = len(size)
    words = np.array([len(x) for x in terms], np.int64)
    key = np.concatenate(terms).astype(np.int64) * n + np.repeat(np.arange(n), words)
    key.sort()
    at_key = np.nonzero(np.diff(key, prepend=-1))[0]
    tf = np.diff(np.append(at_key, key.size))
    term, doc = np.divmod(key[at_key], n)
    weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[doc] / max(mean, 1e-9)))).astype(np.float32)
    # postings lie by term; each document lists the postings of its own terms
    new = np.diff(term, prepend=-1) != 0
    number = np.cumsum(new) - 1
    first = np.append(np.nonzero(new)[0], term.size)
    by_doc = np.argsort(doc, kind="stable")
    terms_of, doc_at = number[by_doc], np.searchsorted(doc[by_doc], np.arange(n + 1))

    used = np.zeros(n, bool)
    begin = np.zeros(n, np.int64)
    order = np.lexsort((np.arange(n), -size))
    windows, at, carry = [], 0, -1
    while True:
        if carry >= 0:
            seed, carry = carry, -1
        else:
            while at < n and used[order[at]]:
                at += 1
            if at == n:
                break
            seed = int(order[at])
        used[seed] = True
        pieces, room = [(seed, int(begin[seed]), int(size[seed]))], window - int(size[seed] - begin[seed])
        if room:
            query = terms_of[doc_at[seed] : doc_at[seed + 1]]
            lengths = first[query + 1] - first[query]
            at_post = np.arange(lengths.sum()) + np.repeat(first[query] - np.concatenate(([0], lengths.cumsum()[:-1])), lengths)
            score = np.bincount(doc[at_post], weight[at_post], n)
            score[used] = -1
            while room:
                fit = np.where(size <= room, score, -1)
                best = int(fit.argmax())
                if fit[best] < 0:
                    best = int(score.argmax())
                    if score[best] < 0:
                        break
                    pieces.append((best, 0, room))
                    begin[best], carry, room = room, best, 0
                    used[best] = True
                    break
                pieces.append((best, 0, int(size[best])))
                room -= int(size[best])
                used[best], score[best] = True, -1
        windows.append(pieces)
    return windows


def packed(
    docs: DataFrame,
    path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    shard_rows: int = SHARD_ROWS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_tokenizer()
    common.byte_batches(docs.sparkSession)
    slim = common.pick(docs).select("doc_id", F.col("text").cast("binary"))
    df, n_docs, total = frequencies(slim)
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)))  # TERMS numbers
    mean = total / max(1, n_docs)

    def part(ids, arrays, terms, weights, base):
        out, whose = [], []
        for k, x in enumerate(arrays):
            full = len(x) // window
            for w in range(full):
                out.append((ids[k], w * window, window, zlib.crc32(x[w * window : (w + 1) * window].tobytes()), len(x), base, 0))
                base += 1
            if len(x) % window:
                whose.append(k)
        sizes = np.array([len(arrays[k]) % window for k in whose], np.int64)
        for pieces in pack_shard(sizes, [terms[k] for k in whose], weights, mean, window) if whose else ():
            offset = 0
            for r, a, b in pieces:
                x = arrays[whose[r]]
                start = len(x) // window * window
                out.append((ids[whose[r]], start + a, b - a, zlib.crc32(x[start + a : start + b].tobytes()), len(x), base, offset))
                offset += b - a
            base += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names), base

    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc, weights, tail = encoder(path), idf.value, np.array([end_id], np.int32)
        ids, arrays, terms, held, now, base = [], [], [], 0, -1, 0
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                some = b.slice(at, CHUNK)
                xs, ts = enc.encoded([x or b"" for x in some.column(1).to_pylist()])
                for d, s, x, t in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), xs, ts):
                    if s != now or len(ids) >= 2 * shard_rows or held >= shard_tokens:
                        if ids:
                            out, base = part(ids, arrays, terms, weights, base)
                            yield out
                        ids, arrays, terms, held = [], [], [], 0
                        now, base = s, base if s == now else s << 32
                    ids.append(d)
                    arrays.append(np.concatenate((x, tail)))
                    terms.append(t)
                    held += len(x)
        if ids:
            yield part(ids, arrays, terms, weights, base)[0]

    shards = max(1, -(-n_docs // shard_rows))
    dealt = slim.withColumn("crc", F.crc32("text")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(shards)))
    slim = dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "crc").select("doc_id", "text", "shard")
    return slim.mapInArrow(run, PIECES)


def op1_bm25_packing(spark, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
