"""Operator 2 - packing documents into sequences (shortest-pack-first over a histogram).

A document's tokens are its tokenizer ids and one end id.  Every full window of
``max_len`` tokens is a piece of its own; the rest of the document is one shorter
piece.  So pieces, and the checksums of their ids, are known from the document alone and
ids are neither stored nor shuffled.  The histogram of piece lengths (at most ``max_len``
rows) is all that reaches the driver.  Where the lengths alone would leave more than
1 - ``least_fill`` of the sequences empty, the emptiest packs are dissolved in the
histogram and their pieces cut to the gaps of the others; the documents of those pieces,
and only they, are tokenized once more for the checksums of the parts.  Lengths go in
longest first, each piece into the pack with the most room, as often as it fits; that
turns the histogram into counts of packing patterns.  Each run of a pattern owns ranks
of its length, and pieces find their place by their rank within their length.  Ranks
come from counts per (length, salt) and a window inside each of those; a length has as
many salts as its count asks for, so no frequent length or row meets in one task.

Defined results: a null or empty text is the end id alone; a very long text gives as
many full windows as it holds; equal rows make pieces of their own, and which of them
takes which place is of no consequence (ties); an empty table gives no piece; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import lean, persist, small_batches

MAX_LEN, END_ID, SALT_ROWS, LEAST_FILL = 2048, 1, 4096, 0.98
#: Fixed value: how byte-level BPE of this vocabulary family splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
QUICK_SPLIT = SPLIT.removesuffix(r"|\s+(?!\S)|\s+") + r"|\s+"
PROBES = (" the", "It's", " naïve,", "12,345.67", " über-großen\nZeilen", " 東京タワー", "\u00a0x\u2003y", "a\tb\r\nc", " #*$%&|<>!!", "👩‍👩‍👧", "e\u0301", "\x00\x7f")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SPREAD = PIECES + ", _spread long, _key long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    The tokenizer file's vocabulary also runs as merge ranks, which is several times
    faster; that form is used only if the file's merges come in the order of their ids,
    make up the whole vocabulary beside the single bytes, and it agrees with the
    tokenizer on PROBES.  Its
    split pattern has a variant without look-ahead that a plain automaton can run; the
    two differ only where white space meets white space, so a text whose ids show such
    a place (or bytes that may begin non-ASCII white space) is encoded again with the
    full pattern.  Texts with a special token's string go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.full = self.quick = None
        self._ranks(json.loads(self.tok.to_str()))

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ranks(self, spec: dict) -> None:
        letters = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}
        try:
            ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
            import tiktoken

            full, quick = (tiktoken.Encoding("words", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (SPLIT, QUICK_SPLIT))
            pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
            made = [ranks[bytes(letters[c] for c in a + b)] for a, b in pairs]
        except (ImportError, KeyError, ValueError):
            return
        if made != sorted(set(made)) or len(made) + 256 != len(ranks):
            return
        if any(np.asarray(full.encode_ordinary(p), "<u4").tobytes() != self._ids(p) for p in PROBES):
            return
        self.blank = np.zeros(max(ranks.values()) + 1, bool)
        self.doubt = self.blank.copy()
        for w, i in ranks.items():
            self.blank[i] = not w.strip(b" \t\n\r\x0b\x0c")
            self.doubt[i] = bool(set(w) & {0xC2, 0xE1, 0xE2, 0xE3}) or (self.blank[i] and len(w) > 1)
        self.full, self.quick = full, quick

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.full is None or any(s in text for s in self.special):
            return self._ids(text)
        ids = self.quick.encode_to_numpy(text, disallowed_special=())
        blank = self.blank[ids]
        if self.doubt[ids].any() or (blank[1:] & blank[:-1]).any():
            ids = self.full.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cut(ids: bytes, end: bytes, max_len: int) -> list[tuple[int, int, int]]:
    ids += end
    n, step = len(ids) // 4, 4 * max_len
    return [(at // 4, min(max_len, n - at // 4), zlib.crc32(ids[at : at + step])) for at in range(0, 4 * n, step)]


def pieces(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and ``_spread``, a number that tells equal rows apart, and a hash of the text."""
    small_batches(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, number = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [_cut(enc.encode(t), end, max_len) for t in part.column(1).to_pylist()]
                k = np.fromiter(map(len, rows), np.int64, len(rows))
                flat = np.array([p for r in rows for p in r], np.int64).reshape(-1, 3)
                total = np.array([r[-1][0] + r[-1][1] for r in rows], np.int64)
                at = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), *(pa.array(flat[:, j]) for j in range(3)), pa.array(np.repeat(total, k)), pa.array(number + np.arange(len(flat))), part.column(2).take(at)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_spread", "_key"],
                )
                number += len(flat)

    return _keyed(docs).mapInArrow(run, _SPREAD)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_key"))


Pattern = tuple[tuple[int, int], ...]  # (length, times), in the order of their places


def shortest_pack_first(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[Pattern, int]]:
    """Length -> count to (pattern, how many sequences have it).

    Longest first; every piece goes into the pack with the most room, the one that has
    just been opened or changed included, and opens a pack only if none has room.  All
    pieces of a length and all packs of a pattern move at once: a length splits one
    pattern and opens two at most, so there are at most 3 * max_len patterns.
    """
    room: list[list[tuple[Pattern, int]]] = [[] for _ in range(max_len + 1)]
    widest = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and widest >= length:
            if not room[widest]:
                widest -= 1
                continue
            pack, n = room[widest].pop()
            used = min(n, left)
            if n > used:
                room[widest].append((pack, n - used))
            again = pack[-1][0] == length
            grown = (*pack[:-1], (length, pack[-1][1] + 1)) if again else (*pack, (length, 1))
            room[widest - length].append((grown, used))
            left -= used
        fit = max_len // length
        for times, n in ((fit, left // fit), (left % fit, 1)):
            if times and n:
                space = max_len - times * length
                room[space].append((((length, times),), n))
                widest = max(widest, space)
    return [(pack, n) for s in room for pack, n in s]


Cut = tuple[int, tuple[int, ...], int]  # a length, its parts, how many pieces are cut so


def _fill(histogram: dict[int, int], patterns: list[tuple[Pattern, int]], max_len: int) -> float:
    n = sum(k for _, k in patterns)
    return sum(length * k for length, k in histogram.items()) / (n * max_len) if n else 1.0


def after(histogram: dict[int, int], cut: list[Cut]) -> dict[int, int]:
    """The histogram once the cuts are made."""
    out = dict(histogram)
    for length, parts, n in cut:
        out[length] -= n
        for part in parts:
            out[part] = out.get(part, 0) + n
    return {k: n for k, n in out.items() if n}


def cuts_to_fill(histogram: dict[int, int], max_len: int = MAX_LEN, least_fill: float = LEAST_FILL) -> list[Cut]:
    """Pieces to cut so that packing leaves little room; none where it does so already.

    The packs beyond what the tokens need at ``least_fill``, emptiest first, are taken
    apart.  Their pieces go, longest first, into the widest gaps of the packs that stay: whole
    where they fit, else cut to the gap.  Pieces and gaps of a kind move at once.
    """
    patterns = shortest_pack_first(histogram, max_len)
    total = sum(length * n for length, n in histogram.items())
    spare = sum(n for _, n in patterns) - -(-total // int(max_len * least_fill)) if total else 0
    if spare <= 0:
        return []
    gaps: dict[int, int] = {}
    loose: dict[tuple[int, int, tuple[int, ...]], int] = {}  # (what is left, of which length, parts so far)
    for space, pack, n in sorted(((max_len - sum(a * k for a, k in pack), pack, n) for pack, n in patterns), reverse=True):
        apart = min(n, spare)
        spare -= apart
        for length, times in pack if apart else ():
            loose[length, length, ()] = loose.get((length, length, ()), 0) + apart * times
        if n > apart and space:
            gaps[space] = gaps.get(space, 0) + n - apart
    cut: dict[tuple[int, tuple[int, ...]], int] = {}
    pieces, widths = [(-a, b, c) for a, b, c in loose], [-g for g in gaps]
    heapq.heapify(pieces)
    heapq.heapify(widths)
    while pieces:
        least, length, parts = heapq.heappop(pieces)
        n = loose.pop((-least, length, parts))
        if not widths:
            cut |= {(length, (*parts, -least)): cut.get((length, (*parts, -least)), 0) + n} if parts else {}
            continue
        gap = -widths[0]
        used, size = min(n, gaps[gap]), min(-least, gap)
        gaps[gap] -= used
        if not gaps[gap]:
            heapq.heappop(widths)
            del gaps[gap]
        if gap > size:
            if gap - size not in gaps:
                heapq.heappush(widths, size - gap)
            gaps[gap - size] = gaps.get(gap - size, 0) + used
        if size == -least:
            if parts:
                cut[length, (*parts, size)] = cut.get((length, (*parts, size)), 0) + used
        else:
            key = (-least - size, length, (*parts, size))
            if key not in loose:
                heapq.heappush(pieces, (-key[0], *key[1:]))
            loose[key] = loose.get(key, 0) + used
        if n > used:
            loose[-least, length, parts] = n - used
            heapq.heappush(pieces, (least, length, parts))
    found = sorted((length, parts, n) for (length, parts), n in cut.items())
    better = after(histogram, found)
    return found if _fill(better, shortest_pack_first(better, max_len), max_len) > _fill(histogram, patterns, max_len) else []


def slots(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """One row per run of a pattern: length, first rank, times, first sequence, offset; by length and rank."""
    out, taken, sequence = [], {}, 0
    for pack, n in patterns:
        offset = 0
        for length, times in pack:
            lo = taken.get(length, 0)
            out.append((length, lo, times, sequence, offset))
            taken[length] = lo + n * times
            offset += length * times
        sequence += n
    rows = np.array(out, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _place(plan):
    """Ranked pieces -> pieces with sequence and offset; the last two columns are the rank and nothing else."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, times, sequence, offset = plan.value.T
        key = length << 48 | first  # lengths below 2^15, ranks below 2^48
        for batch in batches:
            mine, rank = np.asarray(batch.column(2)), np.asarray(batch.column(5))
            at = np.searchsorted(key, mine << 48 | rank, "right") - 1
            k = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + k // times[at]), pa.array(offset[at] + k % times[at] * mine)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def _choose(plan):
    """Ranked pieces -> + the parts that each is cut into, null where it stays whole."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, tuple[np.ndarray, list]] = {}
        for length, parts, n in plan.value:
            ends, kinds = of.setdefault(length, ([0], []))
            ends.append(ends[-1] + n)
            kinds.append(list(parts))
        for batch in batches:
            length, rank = batch.column(2).to_pylist(), batch.column(7).to_pylist()
            parts = []
            for k, r in zip(length, rank, strict=True):
                ends, kinds = of[k]
                parts.append(kinds[bisect_right(ends, r) - 1] if r < ends[-1] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(parts, pa.list_(pa.int64()))], names=[*batch.schema.names[:7], "parts"])

    return run


def _parts(tokenizer: str, end_id: int):
    """(piece, parts, text) -> a piece for each part, with its checksum."""
    end = np.asarray([end_id], "<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, number = encoder(tokenizer), 1 << 62 | TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, at, seen = [], [], {}
            starts, keys, parts, texts = (batch.column(i).to_pylist() for i in (1, 6, 7, 8))
            for i, (start, key, lengths, text) in enumerate(zip(starts, keys, parts, texts, strict=True)):
                if key not in seen:
                    seen = {key: enc.encode(text) + end}  # equal texts mostly stand together
                for n in lengths:
                    rows.append((start, n, zlib.crc32(seen[key][4 * start : 4 * (start + n)])))
                    at.append(i)
                    start += n
            flat, at = np.array(rows, np.int64).reshape(-1, 3), pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), *(pa.array(flat[:, j]) for j in range(3)), batch.column(4).take(at), pa.array(number + np.arange(len(flat))), batch.column(6).take(at)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_spread", "_key"],
            )
            number += len(flat)

    return run


def _recut(docs: DataFrame, p: DataFrame, histogram: dict[int, int], cut: list[Cut], tokenizer: str, end_id: int, salt_rows: int) -> DataFrame:
    """Pieces with the cuts made; documents are told by their id and a hash of their text."""
    spark = docs.sparkSession
    lengths = sorted({length for length, _, _ in cut})  # at most max_len of them
    concerned = p.filter(F.col("length").isin(lengths))
    ranked = _ranked(concerned, {k: histogram[k] for k in lengths}, salt_rows).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_spread", "_key", "_rank")
    chosen = persist(ranked.mapInArrow(_choose(spark.sparkContext.broadcast(cut)), _SPREAD + ", parts array<long>"), "pack-chosen")
    broken = chosen.filter("parts is not null")
    one = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_key"] == b["_key"])
    d, need = _keyed(docs), broken.select("doc_id", "_key").distinct()
    texts = d.join(need, one(d, need), "left_semi").dropDuplicates(["doc_id", "_key"])
    again = broken.join(texts, one(broken, texts)).select(broken["*"], texts["text"]).mapInArrow(_parts(tokenizer, end_id), _SPREAD)
    return p.filter(~F.col("length").isin(lengths)).unionByName(chosen.filter("parts is null").drop("parts")).unionByName(again)


def _ranked(p: DataFrame, histogram: dict[int, int], salt_rows: int) -> DataFrame:
    """Pieces with their rank within their length; a length has a salt for every ``salt_rows`` rows."""
    spark = p.sparkSession
    salts = spark.createDataFrame([(k, -(-n // salt_rows)) for k, n in histogram.items()], "length long, _salts long")
    salt = F.pmod(F.xxhash64("_spread"), F.col("_salts")).alias("_salt")
    p = p.join(F.broadcast(salts), "length").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_spread", "_key", salt)
    counts = persist(p.groupBy("length", "_salt").count(), "pack-counts")
    before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("length", "_salt", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_salt").orderBy("_spread")) - 1
    p = p.withColumn("_inside", inside).join(base, ["length", "_salt"])
    return p.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_spread", "_key", (F.col("_inside") + F.col("_before")).alias("_rank"))


def pack(
    docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID, salt_rows: int = SALT_ROWS, least_fill: float = LEAST_FILL
) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``max_len`` is below 32,768."""
    if not 0 < max_len < 1 << 15:
        raise ValueError("max_len must lie between 1 and 32,767")
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    p = persist(pieces(docs, tokenizer, max_len, end_id), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    if cut := cuts_to_fill(histogram, max_len, least_fill):
        p = persist(_recut(docs, p, histogram, cut, tokenizer, end_id, salt_rows), "pack-cut")
        histogram = after(histogram, cut)
    p = _ranked(p, histogram, salt_rows).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank")
    plan = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, max_len)))
    return p.mapInArrow(_place(plan), PIECES + ", sequence_id long, offset long")


def op2(docs: DataFrame) -> DataFrame:
    return pack(docs)
