"""Packing documents into token sequences: best fit, then a swap-based local search.

Documents are tokenised whole; only those longer than a sequence are cut. Pieces are dealt to groups
of bounded size by a hash, each group is packed by best fit and improved by local search, and the
bins it leaves underfull are packed again in coarser groups, so waste does not add up with the groups.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import settle, short_batches, text_batches

CAPACITY = 4096
GROUP = 4096          # pieces a group is planned for
END = 1               # the id after a document's last token
CACHE = 600_000       # words whose ids a task remembers


def byte_symbols() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def letter_coder(tokenizer):
    """The same vocabulary as a tiktoken encoding of single runs of letters, each ended by a line feed.

    The vocabulary marks a word's end in its last symbol; here the line feed, which no run of letters
    holds, stands for the mark. A merge's rank is its id."""
    import tiktoken

    byte, ranks = {c: b for b, c in byte_symbols().items()}, {}
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        body = token.removesuffix("</w>")
        if body and all(c in byte for c in body):
            ranks[bytes(byte[c] for c in body) + (b"\n" if body != token else b"")] = i
    return tiktoken.Encoding("letters", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})


class Words(dict):
    """Token ids by word, as little-endian unsigned 32-bit bytes, coded when first met.

    The vocabulary never joins what ASCII white space parts, so a text's ids are those of its words. A run
    of Latin letters and the ASCII punctuation after it are parted by the tokenizer too: the letters are
    coded lower-cased by ``letter_coder``. All other words go through the whole tokenizer."""

    LETTERS = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)\Z")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters, self.parts = letter_coder(self.tokenizer).encode_ordinary, {}

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            ids = self.parts[text] = array("I", self.letters(text + "\n")).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self.parts.clear()
        found, ids = self.LETTERS.match(word), None
        if found:
            core, tail = found[1], found[2]
            text = core.decode("utf-8", "replace")
            # Latin letters up to U+017F, composed, and not the dotted capital I: their lower case is plain
            if core.isascii() or (max(text) < "\u0180" and "\u0130" not in text and text.isalpha()):
                ids = self.part(text.lower())
                if tail:
                    ids += self[tail]
        if ids is None:
            ids = array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32) of every piece of every row; ``item`` numbers the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, item = Words(path), TaskContext.get().partitionId() << 40
        for batch, texts in text_batches(batches, "text"):
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), texts):
                ids = coder.ids(t) + END.to_bytes(4, "little")
                n = len(ids) // 4
                for p, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start:4 * (start + capacity)]
                    rows.append((item, doc, p, start, len(part) // 4, zlib.crc32(part)))
                    item += 1
            cols = list(zip(*rows))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["item", "doc_id", "piece", "start", "length", "ids_crc32"])

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(run, "item long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the open bin with the least room that still holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0                                   # bit r is set if some bin has r tokens of room
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        n = lengths[i]
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= n
        by_room[room].append(b)
        open_rooms |= 1 << room
    return bins


class Loose:
    """Underfull bins by what they can give: which bins have a piece, or two pieces together, of a length, the emptiest first."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity, self.fill, self.version = capacity, [sum(lengths[i] for i in b) for b in bins], [0] * len(bins)
        self.held: list[dict[int, list[int]]] = [{} for _ in bins]
        for held, b in zip(self.held, bins):
            for i in b:
                held.setdefault(lengths[i], []).append(i)
        self.live = set(range(len(bins)))
        self.index()

    def index(self) -> None:
        self.heaps: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(self.capacity + 1)] for _ in range(2)]
        self.some = [0, 0]                           # bit n is set if some bin may give one piece, or two, of length n
        for b in self.live:
            self.enter(b)

    def enter(self, b: int) -> None:
        held, one, two = self.held[b], 0, 0
        for n in held:
            one |= 1 << n
        for n, ids in held.items():
            two |= (one if len(ids) > 1 else one & ~(1 << n)) << n
        two &= (1 << self.capacity + 1) - 1
        for heaps, bits in zip(self.heaps, (one, two)):
            while bits:
                n = (bits & -bits).bit_length() - 1
                heapq.heappush(heaps[n], (self.fill[b], b, self.version[b]))
                bits &= bits - 1
        self.some = [self.some[0] | one, self.some[1] | two]

    def emptiest(self, kind: int, n: int, big: int) -> int | None:
        """The emptiest bin besides ``big``, and no fuller than it, that gives ``n``."""
        heap, own = self.heaps[kind][n], None
        while heap and (self.version[heap[0][1]] != heap[0][2] or heap[0][1] == big):
            top = heapq.heappop(heap)
            own = top if self.version[top[1]] == top[2] else own
        found = heap[0] if heap else None
        if own:
            heapq.heappush(heap, own)
        if not heap:
            self.some[kind] &= ~(1 << n)
        return found[1] if found and found[0] <= self.fill[big] else None

    def best(self, big: int) -> tuple[int, int, int, int, int] | None:
        """(gain, kind, length taken, length given, bin) of the change after which ``big`` is fullest."""
        room, found = self.capacity - self.fill[big], None
        for given in (0, *self.held[big]):
            for kind in (0, 1):
                least = found[0] if found else 0                                     # a change must gain more than that
                gains = (self.some[kind] >> given + least + 1) & ((1 << room - least) - 1)
                while gains:
                    top = gains.bit_length()
                    small = self.emptiest(kind, given + least + top, big)
                    if small is not None:
                        found = least + top, kind, given + least + top, given, small
                        break
                    gains ^= 1 << top - 1
                if found and found[0] == room:
                    return found
        return found

    def take(self, b: int, n: int) -> int:
        i = self.held[b][n].pop()
        if not self.held[b][n]:
            del self.held[b][n]
        return i

    def change(self, big: int, gain: int, kind: int, taken: int, given: int, small: int) -> None:
        first = taken if kind == 0 else next(n for n in self.held[small] if len(self.held[small].get(taken - n, ())) > (taken - n == n))
        out = [(given, self.take(big, given))] if given else []
        into = [(n, self.take(small, n)) for n in ([first] if kind == 0 else [first, taken - first])]
        for b, got, more in ((big, into, gain), (small, out, -gain)):
            for n, i in got:
                self.held[b].setdefault(n, []).append(i)
            self.fill[b] += more
            self.version[b] += 1
            if 0 < self.fill[b] < self.capacity:
                self.enter(b)
            else:
                self.live.discard(b)

    def settled(self) -> bool:
        """No bin can be emptied any more."""
        return len(self.live) < 2 or sum(self.fill[b] for b in self.live) > (len(self.live) - 1) * self.capacity


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins while squared fill grows.

    Each step fills a bin from another that is no fuller by the change after which it is fullest, so the
    sum of squared fills grows; a bin that is emptied goes. All underfull bins are looked at, and the
    search ends when none of them has a change or no bin can be emptied any more."""
    full = [list(b) for b in bins if sum(lengths[i] for i in b) == capacity]
    loose = Loose([b for b in bins if sum(lengths[i] for i in b) < capacity], lengths, capacity)
    better = True
    while better and not loose.settled():
        better = False
        for big in sorted(loose.live, key=lambda b: (-loose.fill[b], b)):
            while big in loose.live and (found := loose.best(big)):
                loose.change(big, *found)
                better = True
            if loose.settled():
                break
        loose.index()                                # without what has changed since
    return full + [[i for ids in held.values() for i in ids] for held in loose.held if held]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _packed(capacity: int, slack: int):
    """For applyInPandas: bins of a group. Bins with over ``slack`` tokens of room are left open (no sequence)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        sizes, firsts = pdf.length.tolist(), pdf.item.tolist()
        seq, offset = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64)
        for b in pack(sizes, capacity):
            at = 0
            if slack >= 0 and capacity - sum(sizes[i] for i in b) > slack:
                continue
            name = min(firsts[i] for i in b)         # an item is in one sequence: its number can name it
            for i in b:
                seq[i], offset[i] = name, at
                at += sizes[i]
        return pdf.assign(sequence_id=seq, offset=offset)[["item", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


PACKED = "item long, doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def sequences(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A NULL or empty text is its end id alone. Repeated rows are documents of their own; a NULL doc_id
    stays NULL; no rows give no rows; other columns are ignored. Which pieces meet depends on their
    place in the input only."""
    with short_batches(docs.sparkSession):
        rows = settle(pieces(docs, path, doc_id, text, capacity).withColumn("doc_id", F.col("doc_id").cast("string")), "pieces")
    left, total, done = rows, rows.count(), []
    slack = capacity // 512
    while True:
        groups = max(1, -(-total // group))
        final = groups == 1 or len(done) > 6
        dealt = left.withColumn("g", F.pmod(F.xxhash64("item", F.lit(len(done))), F.lit(groups)))
        packed = dealt.groupBy("g").applyInPandas(_packed(capacity, -1 if final else slack), PACKED)
        if final:
            done.append(packed)
            break
        packed = settle(packed, "packed")
        done.append(packed.where("sequence_id >= 0"))
        left = packed.where("sequence_id < 0").drop("sequence_id", "offset")
        before, total = total, left.count()
        if total > before // 2:      # no progress worth a round: close what is there
            groups = max(1, -(-total // group))
            done.append(left.withColumn("g", F.pmod(F.xxhash64("item", F.lit(-1)), F.lit(groups))).groupBy("g").applyInPandas(_packed(capacity, -1), PACKED))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("item").withColumn("doc_id", F.col("doc_id").cast("long"))
