"""Long spans that records share word for word (problem 9).

The corpus is a de Bruijn graph. Its tokens are code points, its edges all ``k``-mers of tokens, its
nodes the ``k - 1`` tokens between two of them. A ``k``-mer's minimizer is the least hashed
``m``-gram in it; consecutive ``k``-mers of a text with one minimizer are one edge of the graph that
is shuffled, from the node at its start to the node at its end. Equal ``k``-mers have equal
minimizers at equal offsets, so that an edge found in two records is shared as a whole, and an edge
of one record only can share ``k``-mers with no other edge than those of the same minimizer.

1. *Edges.* Those whose minimizer one record alone holds go by a semi-join; the others are grouped by
   content.
2. *Compaction.* Of the edges that several records hold, every node where two meet is aggregated: if
   one edge alone comes in, one alone goes out, and both and their meeting are found equally often,
   the node does not branch, and the edges beside it are joined into one path; what is left is one
   row for each maximal path and place.
3. *Branches.* Edges of one record beside shared ones of the same minimizer are opened by their
   source coordinates, first into blocks of neighbouring ``k``-mers and, where what all of a block
   have in common is held by another record but the block is not, into single ``k``-mers.
4. *Verification.* Every path, block and ``k``-mer names the place where another record has the
   same. Both texts are cut out at these source coordinates and compared as texts. If one pair
   differs, hashes have collided, and all is done again with other hashes.

All steps are joins with partial aggregates; records are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.operators.skew import annotate_groups
from linkwright.store import Table, write

_U = np.uint64
#: Bases of the hashes, one for each attempt; all are odd.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MASK = (1 << 64) - 1
#: Code points hashed at once; positions must fit into the low bits of a packed minimum.
PIECE, _POS_BITS = 1 << 20, 24
#: k-mers in a block.
BLOCK = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, made once in a process."""

    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls.made or len(cls.made[base][0]) < n:
            n = max(n, PIECE + 4096)
            out = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.ones(1, _U)
                while len(p) < n:
                    p = np.concatenate([p, p * _U(pow(b, len(p), 1 << 64))])
                out.append(p[:n])
            cls.made[base] = (out[0], out[1])
        return cls.made[base]


class Hashes:
    """Hashes of any stretch of one piece of text in constant time."""

    def __init__(self, codes: np.ndarray, base: int = _BASES[0]) -> None:
        self.n = len(codes)
        self.pow, self.inv = _Powers.of(base, self.n + 1)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(_mix(codes.astype(_U) + _U(base & 0xFFFF)) * self.pow[: self.n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.inv[begin])

    def grams(self, m: int) -> np.ndarray:
        n = self.n - m + 1
        return _mix((self.sums[m:] - self.sums[:-m]) * self.inv[:n])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` neighbours, by running minima of blocks from both sides."""
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    y = np.full(full, _U(_MASK))
    y[: len(x)] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def edges_of(codes: np.ndarray, owner: np.ndarray, k: int, m: int, base: int) -> tuple[np.ndarray, ...]:
    """First and last k-mer, minimizer, its place, content hash and node at the start of each edge of a piece.

    ``owner`` numbers the text of each code point; k-mers over two texts are left out.
    """
    hashes, w = Hashes(codes, base), k - m + 1
    grams = hashes.grams(m)
    place = np.arange(len(grams), dtype=_U)
    low = _U((1 << _POS_BITS) - 1)
    least = (_window_min((grams & ~low) | place, w) & low).astype(np.int64)
    inside = owner[: len(least)] == owner[k - 1 :]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    change &= inside
    last = np.ones(len(least), bool)
    last[:-1] = (least[1:] != least[:-1]) | ~inside[1:]
    last &= inside
    first, end = np.flatnonzero(change), np.flatnonzero(last)
    return first, end, grams[least[first]], least[first], hashes.of(first, end + k), hashes.of(first, first + k - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(texts: list[str | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points, number of the text and place in the text, in pieces of bounded length.

    A text longer than a piece is cut so that each of its windows lies in exactly one part.
    """
    parts: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def piece() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = [len(p[0]) for p in parts]
        number = np.repeat(np.arange(len(parts)), lengths)
        starts = np.cumsum([0, *lengths[:-1]])
        return np.concatenate([p[0] for p in parts]), number, np.array([(p[1], p[2] - s) for p, s in zip(parts, starts)])

    for i, t in enumerate(texts):
        if not t or len(t) < k:
            continue
        codes = _codes(t)
        for begin in range(0, len(codes) - k + 1, PIECE):
            part = codes[begin : begin + PIECE + k - 1]
            if size and size + len(part) > PIECE + k:
                yield piece()
                parts, size = [], 0
            parts.append((part, i, begin))
            size += len(part)
    if parts:
        yield piece()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def text_edges(df: DataFrame, id_col: str, text_col: str, k: int, m: int, base: int, bits: int) -> DataFrame:
    """``doc, s, e, o, mz, sh, v``: the edges of each text, from the k-mer at ``s`` to the one at ``e``.

    The minimizer lies ``o`` characters after ``s``; ``sh`` is the content's hash, ``v`` the node's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for codes, number, where in _pieces(batch.column(1).to_pylist(), k):
                first, last, mz, at, sh, v = edges_of(codes, number, k, m, base)
                text, shift = where[number[first]].T
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(first + shift, pa.int32()), pa.array(last + shift, pa.int32()), pa.array(at - first, pa.int32()), _signed(mz), _signed(sh & _low(bits)), _signed(v & _low(bits))], ["doc", "s", "e", "o", "mz", "sh", "v"])

    return _texts(df, id_col, text_col, k).mapInArrow(run, "doc bigint, s int, e int, o int, mz bigint, sh bigint, v bigint")


def _texts(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where(F.length("text") >= k)


def _low(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def _blocks(listed: DataFrame, k: int, size: int, base_of: int, bits: int) -> DataFrame:
    """``mz, b, core, whole, lo, hi, a, wh``: the listed edges cut into blocks of k-mers.

    Block ``b`` of a minimizer at ``p`` has the k-mers that begin from ``p - (b + 1) size + 1`` to
    ``p - b size``, as far as the edge goes, beginning at ``a``. ``core`` hashes what they have in
    common, ``whole`` all they cover, ``wh`` each of them.
    """
    cut = _low(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for row, text in enumerate(batch.column(0).to_pylist()):
                codes, fields = _codes(text), lists[row].values
                s, e, o, mz, lo, hi = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                for part in np.unique(s // PIECE):
                    chosen = np.flatnonzero(s // PIECE == part)
                    base = int(part) * PIECE
                    here = codes[base : int(e[chosen].max()) + k]
                    of = Hashes(here, base_of).of
                    n = e[chosen] - s[chosen] + 1
                    path = np.repeat(chosen, n)
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + s[path] - base
                    mini = s[path] + o[path] - base
                    number = (mini - at) // size
                    new = np.ones(len(at), bool)
                    new[1:] = (path[1:] != path[:-1]) | (number[1:] != number[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(at)) - 1
                    begin = mini[first] - number[first] * size
                    core = of(begin, begin - size + 1 + k) & cut
                    whole = of(at[first], at[last] + k)
                    # blocks of other extent are other blocks
                    whole = _mix(whole + (mini[first] - at[first]).astype(_U) * _U(_BASES[1])) & cut
                    windows = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), _signed(of(at, at + k) & cut))
                    own = path[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mz[own]), pa.array(number[first], pa.int32()), _signed(core), _signed(whole), pa.array(lo[own]), pa.array(hi[own]), pa.array(at[first] + base, pa.int32()), windows],
                        ["mz", "b", "core", "whole", "lo", "hi", "a", "wh"])

    return listed.mapInArrow(run, "mz bigint, b int, core bigint, whole bigint, lo bigint, hi bigint, a int, wh array<bigint>")


def _runs(parts: DataFrame, keys: Sequence[str], begin: str, end: str) -> DataFrame:
    """Unions of overlapping or touching ranges of each key."""
    order = Window.partitionBy(*keys).orderBy(begin)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("new", F.when(F.col(begin) <= reach, 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("run")


#: A record and a place in it as one number, of which the least and the greatest are found without sorting.
_PLACES = 1 << 31


def _spot(doc: str, at: Column | str) -> Column:
    return F.col(doc).cast("decimal(20,0)") * F.lit(_PLACES) + (F.col(at) if isinstance(at, str) else at)


def _at(spot: str, doc: str) -> Column:
    return (F.col(spot) - F.col(doc).cast("decimal(20,0)") * F.lit(_PLACES)).cast("int")


def compact_paths(shared: DataFrame) -> DataFrame:
    """``doc, a, b, p_doc, p_a``: the maximal nonbranching paths of shared edges, at each of their places.

    ``shared`` has ``doc, s, b, v, eid, n, lo, at``: an edge that begins at ``s`` with the node ``v``
    and ends at ``b``; it is found ``n`` times, first in ``lo`` at ``at``, where the path is, too.
    Nodes are aggregated by joins of the edges that meet in them; paths hold no branch and no place
    where some records leave, so that all edges of one are found in the same places.
    """
    order = Window.partitionBy("doc").orderBy("s")
    ahead = lambda c: F.lead(c).over(order).alias(f"next_{c}")
    meet = shared.select("eid", "n", "e", ahead("s"), ahead("eid"), ahead("v"), ahead("n")).where("next_s = e + 1")
    nodes = meet.groupBy("next_v").agg(F.min("eid").alias("in0"), F.max("eid").alias("in1"), F.min("next_eid").alias("out0"), F.max("next_eid").alias("out1"), F.min("n").alias("n_in"), F.max("next_n").alias("n_out"), F.count(F.lit(1)).alias("n"))
    # one edge in, one edge out, and nobody comes or goes here
    plain = nodes.where("in0 = in1 and out0 = out1 and n = n_in and n = n_out").select(F.col("out0").alias("eid"), F.lit(True).alias("goes_on"))
    joined = shared.join(plain.groupBy("eid").agg(F.max("goes_on").alias("goes_on")).hint("shuffle_hash"), "eid", "left")
    new = F.when(F.col("goes_on") & (F.lag("e").over(order) + 1 == F.col("s")), 0).otherwise(1)
    path = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = joined.withColumn("new", new).withColumn("path", path)
    head = F.max(F.when(F.col("new") == 1, F.col("at"))).alias("p_a")
    return numbered.groupBy("doc", "path").agg(F.min("s").alias("a"), F.max("b").alias("b"), F.max("lo").alias("p_doc"), head).drop("path")


def _pieces_shared(df: DataFrame, id_col: str, text_col: str, k: int, m: int, base: int, bits: int) -> Table:
    """``doc, a, b, p_doc, p_a``: shared stretches, and a place with the same text to hold each against; null for first places."""
    edges: Table = write(text_edges(df, id_col, text_col, k, m, base, bits), "edges")
    n_edges = edges.df.count()
    # minimizers that several records hold; of the most frequent, there are few, and they come by broadcast
    often = max(100_000, n_edges // 2_000)
    several = write(edges.df.groupBy("mz").agg(F.min("doc").alias("g_lo"), F.max("doc").alias("g_hi"), F.count(F.lit(1)).alias("g_n")).where("g_lo <> g_hi").select("mz", "g_n"), "several")
    near = edges.df.join(several.df.where(F.col("g_n") <= often).select("mz").hint("shuffle_hash"), "mz", "left_semi")
    if n_edges > often:
        near = near.unionByName(edges.df.join(F.broadcast(several.df.where(F.col("g_n") > often).select("mz")), "mz", "left_semi"))
    near = write(near, "near")
    edges.drop()
    several.drop()
    contents = write(near.df.groupBy("mz", "sh").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(_spot("doc", "s")).alias("spot")).select("mz", "sh", "n", "lo", "hi", _at("spot", "lo").alias("at")), "contents")
    groups = contents.df.groupBy("mz").agg(F.max(F.col("lo") == F.col("hi")).alias("open"))
    known = write(contents.df.join(groups.hint("shuffle_hash"), "mz"), "known")
    contents.drop()
    joined = near.df.join(known.df.where(F.col("n") <= often).hint("shuffle_hash"), ["mz", "sh"])
    if n_edges > often:
        joined = joined.unionByName(near.df.join(F.broadcast(known.df.where(F.col("n") > often)), ["mz", "sh"]))
    met = write(joined, "met")
    near.drop()
    known.drop()
    shared = met.df.where("lo <> hi").select("doc", "s", "e", (F.col("e") + k).alias("b"), "v", F.xxhash64("mz", "sh").alias("eid"), "n", "lo", "at")
    paths = write(compact_paths(shared), "paths").df
    # edges of one record only are opened; of the others' contents, one specimen
    opened = met.df.where("open and (lo = hi or (doc = lo and s = at))")
    listed = opened.groupBy("doc").agg(F.collect_list(F.struct("s", "e", "o", "mz", "lo", "hi")).alias("paths"))
    blocks = write(_blocks(_texts(df, id_col, text_col, k).join(listed, "doc").select("text", "paths"), k, max(1, min(BLOCK, k // 8)), base, bits), "blocks")
    met.drop()
    n_blocks = blocks.df.count()
    lo_hi = [F.min("lo").alias("c_lo"), F.max("hi").alias("c_hi")]
    core = annotate_groups(blocks.df, ["mz", "b", "core"], lo_hi, n_blocks, by_hash=True).where("c_lo <> c_hi")
    alive = write(core.select("mz", "b", "core", "whole", "lo", "hi", "a", "wh"), "alive")
    blocks.drop()
    # of equal blocks or k-mers, the first and the last place
    ends = lambda at: [F.min("lo").alias("d0"), F.max("lo").alias("d1"), F.min(_spot("lo", at)).alias("x0"), F.max(_spot("lo", at)).alias("x1"), F.max("hi").alias("d2")]
    sure = write(annotate_groups(alive.df, ["mz", "b", "whole"], ends("a"), n_blocks, min_rows=1, by_hash=True).withColumn("sure", F.col("d0") != F.col("d2")).select("mz", "b", "core", "lo", "hi", "a", "wh", "sure", "d0", "d1", "x0", "x1"), "sure")
    alive.drop()
    # each place is held against the first one, and the first one against the last
    own = _spot("lo", "a") == F.col("x0")
    other = [F.when(own, F.col("d1")).otherwise(F.col("d0")).alias("p_doc"), F.when(own, _at("x1", "d1")).otherwise(_at("x0", "d0")).alias("p_a")]
    whole = sure.df.where("sure and lo = hi").select(F.col("lo").alias("doc"), "a", (F.col("a") + F.size("wh") - 1 + k).alias("b"), *other)
    part = annotate_groups(sure.df.drop("d0", "d1", "x0", "x1"), ["mz", "b", "core"], [F.max(~F.col("sure") & (F.col("lo") == F.col("hi"))).alias("some")], n_blocks, by_hash=True).where("some")
    windows = part.select("mz", "lo", "hi", "sure", "a", F.posexplode("wh").alias("i", "w")).withColumn("a", F.col("a") + F.col("i"))
    held = annotate_groups(windows, ["mz", "w"], ends("a"), BLOCK * n_blocks, by_hash=True).where("d0 <> d2 and lo = hi and not sure")
    single = held.select(F.col("lo").alias("doc"), "a", (F.col("a") + k).alias("b"), *other)
    first = F.when((F.col("doc") != F.col("p_doc")) | (F.col("a") != F.col("p_a")), F.col("p_doc")).alias("p_doc")
    out = write(paths.select("doc", "a", "b", first, "p_a").unionByName(whole).unionByName(single), "pieces")
    sure.drop()
    return out


def _differ(pieces: DataFrame, texts: DataFrame) -> bool:
    """Some stretch is not, letter for letter, what the other record has at the place named for it."""
    ranges = _runs(pieces.where("p_doc is not null").withColumn("shift", F.col("p_a") - F.col("a")), ["doc", "p_doc", "shift"], "a", "b")
    # a place named by several records is cut out once
    both = ranges.select("p_doc", (F.col("a") + F.col("shift")).alias("p_a"), (F.col("b") - F.col("a")).alias("n"), F.explode(F.array(F.struct("doc", "a"), F.struct(F.col("p_doc").alias("doc"), (F.col("a") + F.col("shift")).alias("a")))).alias("x"))
    wanted = both.select("x.doc", "x.a", "n", F.xxhash64("p_doc", "p_a", "n").alias("g")).distinct()
    cut = texts.join(wanted.hint("shuffle_hash"), "doc").select("g", F.expr("substring(text, a + 1, n)").alias("cut"))
    kinds = cut.groupBy("g", "cut").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.count(F.lit(1)).alias("kinds"))
    return not kinds.where("kinds > 1").isEmpty()


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 200, gram: int | None = None, hash_bits: int = 64) -> DataFrame:
    """``id_col, span_start, span_end``: the longest unbroken runs of shared characters of each text.

    A character is shared if it lies in a stretch of ``min_chars`` code points or more that occurs
    verbatim in another record's text. Positions count code points from 0; the end is exclusive.
    Repetition within one record alone does not count. Null, empty and short texts give no row;
    equal texts are shared as wholes; texts of any length are processed whole. Ids must be unique
    integers; extra columns are ignored. Equal texts have equal hashes, so nothing is missed, and
    what has been found is compared letter for letter, so nothing is wrong; ``hash_bits`` are those
    of the first attempt.
    """
    k = min_chars
    m = gram or max(1, 2 * k // 5)
    for attempt, base in enumerate(_BASES):
        pieces = _pieces_shared(df, id_col, text_col, k, m, base, 64 if attempt else hash_bits)
        if not _differ(pieces.df, _texts(df, id_col, text_col, k)):
            return _runs(pieces.df.select("doc", "a", "b"), ["doc"], "a", "b").select(F.col("doc").alias(id_col), F.col("a").alias("span_start"), F.col("b").alias("span_end"))
        pieces.drop()
    raise RuntimeError("hashes of every attempt collide")


def shared_portion(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_spans, shared_chars, shared_part`` for every record, 0 where nothing is shared."""
    sums = spans.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    rows = df.select(id_col, F.coalesce(F.length(text_col), F.lit(0)).alias("n"))
    return rows.join(sums, id_col, "left").select(
        id_col, F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
        F.when(F.col("n") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n")).otherwise(0.0).alias("shared_part"))
