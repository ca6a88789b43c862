"""Packing documents into token sequences, shortest pack first over the histogram of lengths."""

from __future__ import annotations

import heapq
import os
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from newsloom.llm.common import BROADCAST_ROWS, stash

CAPACITY = 4096
#: The id that ends each document.
END = 2
#: Gaps shorter than this are left as padding: no document is cut for them.
LEAST_PIECE = 16
#: Packs with more padding than this are laid out as sequences of a power of two, which need none.
MOST_PADDING = 64
#: Chunks that are encoded as one text, parted by a token that the tokenizer cuts out before all else.
JOINED = 64
#: Distinct chunks of text whose ids a worker keeps; beyond, it forgets them all.
CACHE = 800_000
#: Texts whose ids tell whether a tokenizer can be asked chunk by chunk: case, blanks of each kind, stops, digits, other scripts.
PROBES = ("", " ", "a", "The Cat. Sat, ON the mat.", "two  blanks   three", " leading and trailing ", "line\nfeed\n\nfeeds\tTab", "it's 3.14, 1,000. x.y, z..", "ÉCOLE Straße ıİ ﬁ", "日本語 の テキスト。", "don't-stop (now) [ok]; \"q\"", "a.b. c.d, e", "x\u00a0y \u3000z", "\U0001f600 smile.")
_TOKENIZERS: dict[int, tuple] = {}


class Piece(NamedTuple):
    """Part of the documents of one remainder length: those of ranks from ``rank`` on, as many as the group has packs."""

    length: int
    rank: int
    start: int
    size: int


class Group(NamedTuple):
    """``count`` packs of the same pattern; in pack i each piece comes from the document of rank piece.rank + i."""

    count: int
    pieces: tuple[Piece, ...]

    def used(self) -> int:
        return sum(p.size for p in self.pieces)

    def split(self, n: int) -> tuple[Group, Group]:
        return self._replace(count=n), Group(self.count - n, tuple(p._replace(rank=p.rank + n) for p in self.pieces))


def shortest_first(items: list[tuple[int, Piece]], capacity: int) -> list[Group]:
    """(count, piece) to groups of packs: longest pieces first, each to the emptiest pack if it fits there, else to a new
    one. Counts stay counts, so the work depends on the number of distinct lengths, not of documents."""
    heap: list[tuple[int, int]] = []
    groups: dict[int, Group] = {}

    def put(group: Group) -> None:
        groups[n := len(groups)] = group
        heapq.heappush(heap, (group.used(), n))

    for count, piece in sorted(items, key=lambda x: -x[1].size):
        while count:
            if heap and heap[0][0] + piece.size <= capacity:
                _, n = heapq.heappop(heap)
                take, rest = groups.pop(n), None
                groups[n] = Group(0, ())
                if take.count > count:
                    take, rest = take.split(count)
                    put(rest)
                put(Group(take.count, (*take.pieces, piece)))
                piece, count = piece._replace(rank=piece.rank + take.count), count - take.count
            else:
                each = min(count, capacity // piece.size)
                packs = count // each
                put(Group(packs, tuple(piece._replace(rank=piece.rank + j * packs) for j in range(each))))
                piece, count = piece._replace(rank=piece.rank + each * packs), count - each * packs
    return [g for g in groups.values() if g.count]


def fill(groups: list[Group], capacity: int, least: int) -> list[Group]:
    """Dissolve as many of the emptiest packs as the gaps of the others hold, and cut their pieces into those gaps."""
    gap = lambda g: capacity - g.used()
    groups = sorted(groups, key=gap, reverse=True)
    spare = sum(g.count * gap(g) for g in groups if gap(g) >= least) // capacity
    donors, takers, done = [], deque(), []
    for g in groups:
        if (n := min(spare, g.count)) > 0:
            spare -= n
            gone, g = g.split(n)  # noqa: PLW2901
            donors += [(n, p) for p in gone.pieces]
        if g.count:
            (takers if gap(g) >= least else done).append(g)
    given = deque(sorted(donors, key=lambda x: -x[1].size))
    while given and takers:
        (count, piece), taker = given.popleft(), takers.popleft()
        n = min(count, taker.count)
        if taker.count > n:
            taker, rest = taker.split(n)
            takers.appendleft(rest)
        if count > n:
            given.appendleft((count - n, piece._replace(rank=piece.rank + n)))
        size = min(piece.size, gap(taker))
        if piece.size > size:
            given.appendleft((n, piece._replace(start=piece.start + size, size=piece.size - size)))
        taker = Group(n, (*taker.pieces, piece._replace(size=size)))
        if gap(taker) >= least:
            takers.appendleft(taker)
        else:
            done.append(taker)
    return [*done, *takers, *shortest_first(list(given), capacity)]


def halves(group: Group, capacity: int) -> list[Group]:
    """A group as groups of sequences whose lengths are powers of two."""
    out, pieces, used = [], deque(group.pieces), group.used()
    for size in (1 << i for i in range(capacity.bit_length() - 1, -1, -1) if used >> i & 1):
        own, room = [], size
        while room:
            p = pieces.popleft()
            own.append(p._replace(size=min(p.size, room)))
            if p.size > room:
                pieces.appendleft(p._replace(start=p.start + room, size=p.size - room))
            room -= own[-1].size
        out.append(Group(group.count, tuple(own)))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, least: int = LEAST_PIECE, most: int = MOST_PADDING) -> list[tuple[int, int, int, int, int, int, int]]:
    """Counts of documents by remainder length (1 to capacity - 1) to slots (length, rank, count, start, size, sequence,
    offset): documents of that length with ranks from rank on, count of them, have their ids from start on, size of them,
    at offset in the sequences from sequence on."""
    groups = fill(shortest_first([(n, Piece(length, 0, 0, length)) for length, n in histogram.items()], capacity), capacity, least)
    laid = [h for g in groups for h in (halves(g, capacity) if capacity - g.used() > most else [g])]
    slots, sequence = [], 0
    for g in laid:
        offset = 0
        for p in g.pieces:
            slots.append((p.length, p.rank, g.count, p.start, p.size, sequence, offset))
            offset += p.size
        sequence += g.count
    return slots


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    A tokenizer that folds case, drops white space and starts a token between a letter and a full stop or comma gets the chunks
    between spaces and line feeds apart, in lower case, without such an ending, and they are remembered. Whether it is of this
    kind is asked of it with PROBES; any other gets whole texts.
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # an executor's cores already have a task each
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(tokenizer), {}
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.added = [t.content.encode().lower() for _, t in added]
        self.between = next(((n, t.content) for n, t in added if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)

        self.by_chunks = True
        self.by_chunks = self.encode(list(PROBES)) == self.alone(list(PROBES))
        self.known = {}

    def alone(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk. An added token is cut out before anything is normalised or merged, so the chunks between
        are encoded as they are alone; those that could hold part of one, or the end of one, are encoded alone."""
        texts = [c.decode() for c in chunks]
        if self.between is None:
            return self.alone(texts)
        mark, sign = self.between
        apart = [i for i, t in enumerate(texts) if sign[0] in t or sign[-1] in t]
        out = dict(zip(apart, self.alone([texts[i] for i in apart]), strict=True))
        rest = [i for i in range(len(texts)) if i not in out]
        groups = [rest[at : at + JOINED] for at in range(0, len(rest), JOINED)]
        found = self.tokenizer.encode_batch_fast([sign.join(map(texts.__getitem__, g)) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            own = np.array(e.ids, "<u4")
            ends = [*np.flatnonzero(own == mark).tolist(), len(own)]
            if len(ends) != len(group):
                out.update(zip(group, self.alone([texts[i] for i in group]), strict=True))
                continue
            data, start = own.tobytes(), 0
            for i, end in zip(group, ends, strict=True):
                out[i] = data[4 * start : 4 * end]
                start = end + 1
        return [out[i] for i in range(len(texts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunks:
            return self.alone(texts)
        lowered = [t.encode().lower() for t in texts]
        # an added token counts only as it is written, so texts that have one in any case are encoded whole
        whole = [i for i, t in enumerate(lowered) if any(a in t for a in self.added)]
        chunks = [t.replace(b"\n", b" ").split(b" ") for t in lowered]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        new = set().union(*chunks).difference(known)
        parts = {c: (c[:-1], c[-1:]) for c in new if c.endswith((b".", b",")) and c[-2:-1].isalpha()}
        fresh = list(new.difference(parts).union(*parts.values()).difference(known))
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            known.update(zip(part, self.ids(part), strict=True))
        known.update((c, known[bare] + known[sign]) for c, (bare, sign) in parts.items())
        get = known.__getitem__
        out = [b"".join(map(get, own)) for own in chunks]
        for i, ids in zip(whole, self.alone([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def _encoder(tokenizer) -> Encoder:  # noqa: ANN001
    """One encoder for each worker process and broadcast."""
    if tokenizer.id not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[tokenizer.id] = (Encoder(tokenizer.value),)
    return _TOKENIZERS[tokenizer.id][0]


class _Text(NamedTuple):
    id: int
    value: str


def tokens(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, text) -> a row for each document: (part, row) name it; crcs are those of its whole stretches of ``capacity``
    ids; length, crc and rest are of the remainder (rest: unsigned 16-bit ids); place is its rank among the part's
    remainders of that length, and whole the number of whole stretches before it in the part."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(_Text(hash(sent.value), sent.value))
        part, row, whole, places = TaskContext.get().partitionId(), 0, 0, Counter()
        last, step = np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, len(batch), 512):
                out = defaultdict(list)
                few = batch.iloc[at : at + 512]
                for doc_id, ids in zip(few["doc_id"], encoder.encode(list(few["text"])), strict=True):
                    ids += last  # noqa: PLW2901
                    n = len(ids) // 4
                    full = n // capacity
                    rest = ids[full * step :]
                    length = len(rest) // 4
                    small = np.frombuffer(rest, "<u4")
                    for k, v in (("part", part), ("row", row), ("doc_id", doc_id), ("n", n), ("crcs", [crc32(ids[i * step : (i + 1) * step]) for i in range(full)]), ("whole", whole), ("length", length), ("place", places[length]), ("crc", crc32(rest)), ("rest", small.astype("<u2").tobytes() if small.max(initial=0) < 1 << 16 else rest)):
                        out[k].append(v)
                    places[length] += 1
                    whole += full
                    row += 1
                yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "part int, row long, doc_id long, n long, crcs array<long>, whole long, length int, place long, crc long, rest binary")


@F.pandas_udf(LongType())
def _cut_crc(rest: pd.Series, length: pd.Series, start: pd.Series, size: pd.Series) -> pd.Series:
    """The CRC-32 of some of a remainder's ids."""
    cut = lambda r, n, s, k: crc32(np.frombuffer(r, "<u2" if len(r) == 2 * n else "<u4")[s : s + k].astype("<u4").tobytes())
    return pd.Series([cut(*x) for x in zip(rest, length, start, size, strict=True)], dtype="int64")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    ``tokenizer`` is the text of a tokenizers file. Every document's ids and one ``end`` lie in exactly one piece each.
    Whole stretches of ``capacity`` ids are sequences of their own, with negative ids. Remainders are packed by their
    histogram, at most ``capacity`` counts on the driver; the plan's slots are broadcast up to BROADCAST_ROWS of them, and a document
    finds its slots by its rank among the remainders of its length: its rank within its part plus the counts of the parts
    before, so no task sees all documents of a length. Ids move only for documents that are cut. Padding is under one
    LEAST_PIECE a sequence. Null and empty texts are one ``end``; repeated rows are separate documents; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    whole = stash(tokens(docs, tokenizer, capacity, end), "tokens")
    counted = stash(whole.where("length > 0").groupBy("length", "part").agg(F.count("*").alias("n")), "token-counts")
    slots = plan({r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = whole.where("length > 0").select("part", "row", "doc_id", "n", "length", "place", "crc").join(counted.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    names = ["s_length", "s_rank", "s_count", "s_start", "s_size", "s_sequence", "s_offset"]
    laid = spark.createDataFrame(pd.DataFrame(slots, columns=names, dtype="int64"), ", ".join(f"{n} long" for n in names))
    here = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_rank")) & (F.col("rank") < F.col("s_rank") + F.col("s_count"))
    placed = ranked.join(F.broadcast(laid) if len(slots) <= BROADCAST_ROWS else laid, here).withColumn("sequence_id", F.col("s_sequence") + F.col("rank") - F.col("s_rank"))
    entire = placed.where("s_size = length").withColumn("ids_crc32", F.col("crc"))
    lengths = sorted({s[0] for s in slots if s[4] < s[0]})
    cut = placed.where("s_size < length").join(whole.where(F.col("length").isin(lengths)).select("part", "row", "rest"), ["part", "row"]).withColumn("ids_crc32", _cut_crc("rest", "length", "s_start", "s_size"))
    columns = ["doc_id", (F.col("n") - F.col("length") + F.col("s_start")).alias("start"), F.col("s_size").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", F.col("s_offset").alias("offset")]
    stretches = whole.where("size(crcs) > 0").select("doc_id", "n", "part", "whole", F.posexplode("crcs").alias("i", "ids_crc32"))
    number = -1 - (F.col("part").cast("long") * (1 << 36) + F.col("whole") + F.col("i"))
    full = stretches.select("doc_id", (F.col("i").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(entire.select(*columns)).unionByName(cut.select(*columns))
