"""N-gram Jaccard join with several global token orders (operator 7).

Documents with equal shingle sets are one node. Two different sets can only reach the threshold if,
under *any* order of all tokens, they share at least L tokens among the first ``n - ceil(t n) + L`` of
each (or their whole overlap, for small sets). Candidates must pass this under three orders: A proposes
them by equi-joins on prefix tokens (L = ``SHARED``), B and C are intersected as count filters on short
sketches (L = ``MORE``), and what is left is verified on the whole sets.

All orders put frequent shingles last (counted over all documents in a first pass: a shingle that holds
at least ``1 / HEAVY`` of all occurrences, so the list is bounded), so a very common line or passage is
in a prefix only when little else is in the text.

No pairs are made inside a group of copies: each node first meets one hub of the tokens it shares (the
hub it shares most with); verified links give components. Then each cell (the nodes of like size that
share an A token, at most ``CELL``) of more than ``SMALL`` nodes proposes a spanning forest of its closest
pairs, so a group of near copies of each other gives as many pairs as it has nodes. After that only nodes of
*different* components that share A tokens are compared, all of them; large cells bound a pair's distance
by the parity sketches of the whole sets before they propose it, and a pair that such a cell has judged is
not looked at again in small ones. So the rest is complete without the pairs that could tell nothing new.

A parity sketch has one bit for each slot: whether an odd number of the set's tokens fall into it. Two
sketches differ in no more bits than the sets in tokens, so what it rejects is no link.

Words are runs of non-blanks, A-Z lower-cased. With fewer words than a shingle the whole sequence is one
shingle. Null and empty texts have no shingles and are linked with nothing: their component is their own
doc_id. Null doc_ids take part; a component's id is its smallest non-null doc_id (null if it has none).
Repeated rows are equal sets. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textvec as tv
from riskloom.llm.common import TEXT_HASH, bitmap, components, cut, id_text, in_bitmap, prepare, sized

SHINGLE = 3
PERCENT = 90
SHARED = 4
MORE = 16
HEAVY = 1 << 17
LEAST_HEAVY = 64
CELL = 1024
SMALL = 64
CELL_ROWS = 100_000
SALTS = tuple(tv.U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(tv.grams(h, min(k, len(h)))) if len(h) else h for h, _, _ in tv.batch_words(texts, tv.SPACE_SEP)]


def heavy_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their frequency class; tasks report what repeats among a few thousand documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, total = [], 0, 0

        def report():
            tok, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"token": tv.signed(tok[n >= 4]), "n": n[n >= 4]})

        for pdf in batches:
            for s in shingle_sets([tv.to_bytes(t) for t in pdf["text"].tolist()], k):
                held.append(s)
                size += len(s)
            total += sum(map(len, held[-len(pdf):]))
            if size > 1 << 21:
                yield report()
                held, size = [], 0
        if held:
            yield report()
        yield pd.DataFrame({"token": pd.array([None], dtype="Int64"), "n": [total]})

    counted = cut(docs.mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = counted.filter("token IS NULL").agg(F.sum("n")).collect()[0][0] or 0
    least = max(LEAST_HEAVY, total // HEAVY)
    # at most HEAVY rows: each holds at least 1 / HEAVY of all occurrences
    got = counted.filter((F.col("n") >= least) & F.col("token").isNotNull()).toArrow()
    tok = got["token"].to_numpy().view(np.uint64)
    order = np.argsort(tok)
    return tok[order], np.log2(got["n"].to_numpy().astype(float))[order].astype(np.uint64) if len(tok) else np.zeros(0, np.uint64)


def prefixes(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix of a set under order A (whole hashes) and the longer sketches under B and C (16 bits a token, with
    repeats: two sketches share at least as many values as tokens)."""
    n = len(s)
    least = n - (percent * n + 99) // 100
    rank = np.zeros(n, np.uint64)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], s), len(heavy[0]) - 1)
        rank = np.where(heavy[0][at] == s, heavy[1][at], tv.U(0))
    out = []
    for salt, m in zip(SALTS, (least + SHARED, least + MORE, least + MORE)):
        key = rank << tv.U(57) | tv.mix(s ^ salt) >> tv.U(7)
        out.append(s[np.argpartition(key, m - 1)[:m]] if m < n else s)
    return out[0], *(np.sort(x.astype(np.uint16)) for x in out[1:])


def shared(p: np.ndarray, q: np.ndarray) -> int:
    """Common values of two sorted sketches, with repeats."""
    p, q = (x.astype(np.int64) << 16 | _nth(x) for x in (p, q))
    return len(np.intersect1d(p, q, assume_unique=True))


def _nth(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value of a sorted array."""
    if not len(x):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], x[1:] != x[:-1]])
    return np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1]


def parity(s: np.ndarray) -> bytes:
    """Parity sketch of a set, of a power of two of bits, as many as tokens at least."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> tv.U(16) & tv.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch as one of ``size`` bytes: slots that are equal in fewer bits fall together."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


def reach(nx, ny, differ, percent: int):
    """Whether sets of these sizes that differ in so many tokens at least can reach the threshold."""
    both = (nx + ny - differ) // 2
    return 100 * both >= percent * (nx + ny - both)


def digest_sets(docs: DataFrame, heavy: tuple, k: int, percent: int) -> DataFrame:
    """Per document row: size and key of its set, key of its text, prefix A, sketches B, C and parity sketch."""
    held = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [tv.to_bytes(t) for t in pdf["text"].tolist()]
            rows = []
            for d, t, s in zip(pdf["doc_id"].tolist(), texts, shingle_sets(texts, k)):
                if len(s):
                    a, b, c = prefixes(s, held.value, percent)
                    rows.append((d, len(s), tv.digest16(s.tobytes()), tv.digest16(t), tv.signed(a), b.tobytes(), c.tobytes(), parity(s)))
                else:
                    rows.append((d, 0, None, None, np.zeros(0, np.int64), None, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "key", "text_key", "a", "b", "c", "s"])
            yield out.astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, "doc_id long, n long, key binary, text_key binary, a array<long>, b binary, c binary, s binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(nid, s): whole sorted sets of the wanted nodes (nid, text_key). The texts are read again; a fixed-size
    bit set of text keys passes few others, an equi-join is exact."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.expr(TEXT_HASH))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [tv.to_bytes(t) for t in pdf["text"].tolist()]
            keys = [tv.digest16(t) for t in texts]
            h = np.array([int.from_bytes(x[:8], "big") for x in keys], np.uint64)
            some = np.flatnonzero(in_bitmap(held.value, h)) if len(h) else []
            sets = shingle_sets([texts[i] for i in some], k)
            yield pd.DataFrame({"text_key": [keys[i] for i in some],
                                "s": [s.tobytes() for s in sets]})

    read = docs.select("text").mapInPandas(run, "text_key binary, s binary").dropDuplicates(["text_key"])
    return read.join(wanted, "text_key").drop("text_key")


def intersect_orders(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of like size whose sketches under B and under C share as many tokens as the threshold needs,
    and whose whole sets can reach it by their parity sketches."""
    one, two = (sets.select(F.col("nid").alias(i), *[F.col(c).alias(c + i) for c in ("n", "b", "c", "s")]) for i in "xy")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for nx, ny, *sketches in pdf[["nx", "ny", "bx", "by", "cx", "cy", "sx", "sy"]].itertuples(index=False, name=None):
                size = min(map(len, sketches[4:]))
                differ = int(np.bitwise_count(np.bitwise_xor(*(folded(x, size) for x in sketches[4:]))).sum())
                bx, by, cx, cy = (np.frombuffer(x, np.uint16) for x in sketches[:4])
                least = need(max(nx, ny), percent, MORE)
                ok.append(reach(nx, ny, differ, percent) and shared(bx, by) >= least and shared(cx, cy) >= least)
            yield pdf.loc[ok, ["x", "y"]]

    fit = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    return pairs.join(one, "x").join(two, "y").filter(fit).select(
        "x", "y", "nx", "ny", "bx", "by", "cx", "cy", "sx", "sy").mapInPandas(run, "x long, y long")


def need(n, percent: int, most: int):
    """Tokens that two prefixes must share: ``most``, or the whole overlap of small sets (n: the larger size)."""
    return np.minimum(most, (percent * n + 99) // 100)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the pairs: 100 * intersection >= percent * union on whole sets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for p, q in zip(pdf["sx"], pdf["sy"]):
                a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pdf.loc[ok, ["x", "y"]].rename(columns={"x": "u", "y": "v"})

    one, two = sets.select(F.col("nid").alias("x"), F.col("s").alias("sx")), sets.select(F.col("nid").alias("y"), F.col("s").alias("sy"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "sx", "sy").mapInPandas(run, "u long, v long")


def shared_tokens(nodes: DataFrame) -> DataFrame:
    """(token, nid, n): A-prefix tokens that several nodes have."""
    spark = nodes.sparkSession
    counts = cut(nodes.select(F.explode("a").alias("token")).groupBy("token").agg(F.count("*").alias("members")).filter("members > 1").select("token"))
    held = spark.sparkContext.broadcast(bitmap(counts))

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [len(x) for x in pdf["a"]]
            flat = np.concatenate(pdf["a"].to_list()).astype(np.int64) if len(pdf) else np.zeros(0, np.int64)
            ok = in_bitmap(held.value, flat.view(np.uint64))
            at = np.repeat(np.arange(len(pdf)), sizes)[ok]
            yield pd.DataFrame({"token": flat[ok], "nid": pdf["nid"].to_numpy()[at], "n": pdf["n"].to_numpy()[at]})

    rows = nodes.select("nid", "n", "a").mapInPandas(thin, "token long, nid long, n int")
    return cut(rows.join(counts, "token"))


def hub_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """One pair per node: the hub (smallest node of a token and size class) it meets most often; and the hubs of
    a token's neighbouring size classes, which one group of copies may straddle."""
    hubs = cut(rows.groupBy("token", "band").agg(F.min("nid").alias("hub"), F.count("*").alias("members")))
    met = rows.join(hubs.filter("members > 1").drop("members"), ["token", "band"]).filter("hub <> nid").groupBy("nid", "hub").agg(
        F.count("*").alias("met"))
    best = met.groupBy("nid").agg(F.max(F.struct("met", "hub")).alias("m")).select(F.col("nid").alias("x"), F.col("m.hub").alias("y"), "m.met")
    # a token has few size classes: their number is the logarithm of the largest size
    steps = hubs.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("band", "hub"))).alias("b")).filter(F.size("b") > 1).select(
        F.explode(F.arrays_zip(F.expr("slice(b, 1, size(b) - 1)").alias("one"), F.expr("slice(b, 2, size(b) - 1)").alias("two"))).alias("z"))
    across = steps.filter("z.two.band - z.one.band = 1 AND z.one.hub <> z.two.hub").groupBy(
        F.col("z.one.hub").alias("x"), F.col("z.two.hub").alias("y")).agg(F.count("*").alias("met"))
    # only a first guess at links: nodes that share less than a third of a prefix are left to the complete second round
    size = nodes.select(F.col("nid").alias("x"), (F.col("n") * (100 - percent) / 100 + SHARED).alias("prefix"))
    return best.union(across).join(size, "x").filter("3 * met >= prefix").select("x", "y").distinct()


def mixed_rows(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (with their component and the token's rows, m) of tokens that nodes of different components have."""
    named = rows.join(comp.select(F.col("node").alias("nid"), "component"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    mixed = named.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter(
        "c0 <> c1").select("token", "m")
    return cut(named.join(mixed, "token"))


def size_classes(there: DataFrame) -> DataFrame:
    """Nodes of a token that many have stand in their own size class and the next (m: rows of token and class):
    sizes that can match differ by one class at most."""
    many = cut(there.filter(F.col("m") > SMALL).drop("m").withColumn("class", F.explode(F.array(F.col("band"), F.col("band") + 1))))
    sized = many.groupBy("token", "class").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1"),
                                               F.max("band").alias("top")).filter("c0 <> c1 AND top = class").select("token", "class", "m")
    return many.join(sized, ["token", "class"])


KEY = ["token", "class", "p", "q"]


def in_cells(cells: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(x, y, need) of ``cell_pairs`` over whole cells."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= CELL_ROWS:
                whole = pd.concat(held)
                last = (whole[KEY] == whole[KEY].iloc[-1]).all(axis=1)
                held = [whole[last]]  # the last cell may go on in the next batch
                yield cell_pairs(whole[~last], percent, forest)
        if held:
            yield cell_pairs(pd.concat(held), percent, forest)

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, *KEY).sortWithinPartitions(*KEY).mapInPandas(compare, "x long, y long, need int")


def near_pairs(rows: DataFrame, nodes: DataFrame, comp: DataFrame, percent: int, cell: int) -> DataFrame:
    """Closest pairs of different components in large cells, a spanning forest of each. Only a guess at links that
    leaves few components to the complete round: a row stands in one cell, of two size classes and at most some
    ``cell`` nodes; which classes and nodes stand together differs by token, and near copies share many tokens."""
    there = mixed_rows(rows, comp).filter(F.col("m") > SMALL).drop("m").withColumn(
        "sizes", F.floor((F.col("band") + F.pmod(F.xxhash64("token"), F.lit(2))) / 2).cast("int"))
    sized = there.groupBy("token", "sizes").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter(
        F.expr(f"c0 <> c1 AND m > {SMALL}")).select("token", "sizes", F.ceil(F.col("m") / cell).alias("nb"))
    own = (F.col("sizes") * F.col("nb") + F.pmod(F.xxhash64("nid", "token"), F.col("nb"))).cast("int")
    cells = there.join(sized, ["token", "sizes"]).select(
        "token", F.lit(-1).alias("class"), own.alias("p"), own.alias("q"), own.alias("own"), "nid", "n", "component", "band",
        F.lit(None).cast("array<long>").alias("judged"))
    return in_cells(cells.join(nodes.select("nid", F.col("s").alias("b")), "nid"), percent, True).select("x", "y").distinct()


def rest_pairs(rows: DataFrame, nodes: DataFrame, comp: DataFrame, percent: int, cell: int) -> DataFrame:
    """Pairs of different components and like size that share as many A tokens as the threshold needs."""
    there = mixed_rows(rows, comp)
    # What goes beyond one cell goes to every pair of its blocks, each pair a task-sized group.
    many = size_classes(there)
    zero = F.lit(0)
    cols = ["token", "class", "p", "q", "own", "nid", "n", "component", "band"]
    large = cut(many.filter(F.col("m") > SMALL).withColumn("nb", F.ceil(F.col("m") / cell)).withColumn(
        "own", F.pmod(F.xxhash64("nid"), F.col("nb")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1))).withColumn(
        "p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).select(*cols))
    # per node the large cells it stands in (at most two a prefix token); the last byte is the size class
    judged = cut(large.groupBy("nid").agg(F.collect_set(F.xxhash64("token").bitwiseAND(F.lit(~255)).bitwiseOR(
        F.pmod("class", F.lit(256)).cast("long"))).alias("judged")))
    large = large.join(nodes.select("nid", F.col("s").alias("b")), "nid").withColumn("judged", F.lit(None).cast("array<long>"))
    small = there.filter(F.col("m") <= SMALL).withColumn("class", F.lit(-1)).unionByName(many.filter(F.col("m") <= SMALL)).select(
        "token", "class", zero.alias("p"), zero.alias("q"), zero.alias("own"), "nid", "n", "component", "band", F.lit(None).cast("binary").alias("b"))
    small = small.join(judged, "nid", "left")
    found = in_cells(small.unionByName(large.select(*small.columns)), percent, False)
    return found.groupBy("x", "y").agg(F.count("*").alias("met"), F.min("need").alias("need")).filter("met >= need").select("x", "y")


def cell_pairs(pdf: pd.DataFrame, percent: int, forest: bool = False) -> pd.DataFrame:
    """Pairs of whole cells (rows sorted by cell): components differ, sizes fit and, in large cells, the parity
    sketches allow the overlap that the threshold asks for. ``forest``: of large cells only a spanning forest of the closest."""
    if not len(pdf):
        return pd.DataFrame({"x": np.zeros(0, np.int64), "y": np.zeros(0, np.int64), "need": np.zeros(0, np.int32)})
    token, cls, p, q, own, nid, n, comp, band = (pdf[c].to_numpy(np.int64) for c in (
        "token", "class", "p", "q", "own", "nid", "n", "component", "band"))
    new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (token, cls, p, q)], axis=0)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(pdf)))
    sketches = pdf["b"].to_numpy()
    judging = np.array([x is not None for x in sketches])  # also small blocks of a large cell: no other cell looks at their pairs
    by_cell = (size > SMALL) | judging[first] & (size > 1)
    ones, twos = [], []
    for m in np.unique(size[(size > 1) & ~by_cell]):
        at = first[(size == m) & ~by_cell]
        for i in range(m):
            for j in range(i + 1, m):
                ones.append(at + i)
                twos.append(at + j)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, twos))
    ok = _fits(a, b, n, comp, band, cls, own, p, q, percent)
    a, b = _not_judged(a[ok], b[ok], pdf["judged"], band)
    xs, ys, needs = [a], [b], [need(np.maximum(n[a], n[b]), percent, SHARED)]
    for lo, m in zip(first[by_cell], size[by_cell]):
        a, b = (x + lo for x in np.triu_indices(m, 1))
        ok = _fits(a, b, n, comp, band, cls, own, p, q, percent)
        if not ok.any():
            continue
        a, b = a[ok], b[ok]
        if judging[lo]:
            differ = _sketch_distances(sketches[lo:lo + m])[a - lo, b - lo]
            ok = reach(n[a], n[b], differ, percent)
            a, b = a[ok], b[ok]
            if forest and len(a) >= m:
                a, b = (x + lo for x in _forest(a - lo, b - lo, differ[ok], comp[lo:lo + m]))
        xs.append(a)
        ys.append(b)
        needs.append(np.ones(len(a), np.int64))  # the bound is stronger than any count of shared tokens
    a, b = np.concatenate(xs), np.concatenate(ys)
    return pd.DataFrame({"x": np.maximum(nid[a], nid[b]), "y": np.minimum(nid[a], nid[b]), "need": np.concatenate(needs)})


def _not_judged(a: np.ndarray, b: np.ndarray, judged: pd.Series, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the pairs that a large cell of both (in the class of the larger) has judged."""
    sets = [None if x is None else frozenset(x.tolist()) for x in judged]
    has = np.array([x is not None for x in sets])
    ok = np.ones(len(a), bool)
    for i in np.flatnonzero(has[a] & has[b]):
        x, y = sets[a[i]], sets[b[i]]
        if not x.isdisjoint(y):
            cls = int(max(band[a[i]], band[b[i]])) % 256
            ok[i] = not any(c & 255 == cls for c in x & y)
    return a[ok], b[ok]


def _fits(a, b, n, comp, band, cls, own, p, q, percent: int) -> np.ndarray:
    big, small = np.maximum(n[a], n[b]), np.minimum(n[a], n[b])
    ok = (comp[a] != comp[b]) & (small * 100 >= big * percent) & ((cls[a] < 0) | (np.maximum(band[a], band[b]) == cls[a]))
    return ok & ((p[a] == q[a]) | (own[a] != own[b]))


def _sketch_distances(sketches: np.ndarray) -> np.ndarray:
    """Bits in which each two parity sketches of a cell differ, as a product of their bit matrix."""
    size = min(map(len, sketches))
    packed = np.array([folded(x, size) for x in sketches])
    same = np.zeros((len(packed), len(packed)), np.float32)
    for lo in range(0, size, 256):
        m = np.unpackbits(packed[:, lo:lo + 256], axis=1).astype(np.float32)
        same += m @ m.T
    each = np.diag(same)
    return (each[:, None] + each - 2 * same).astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, differ: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest of the pairs (Prim), nodes of equal components taken as one."""
    m, none = len(comp), np.iinfo(np.int64).max
    far = np.full((m, m), none)
    far[a, b] = far[b, a] = differ + 1
    far[comp[:, None] == comp] = 0
    best, near, left = np.full(m, none), np.full(m, -1), np.arange(m)
    ones, twos = [], []
    while len(left):
        at = np.argmin(best[left])
        i = left[at]
        left = np.delete(left, at)
        if 0 < best[i] < none:
            ones.append(near[i])
            twos.append(i)
        closer = far[i] < best
        best[closer], near[closer] = far[i][closer], i
    return np.array(ones, np.int64), np.array(twos, np.int64)


def join_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with further links, which join whole components: only those edges are left."""
    for end in ("u", "v"):
        links = links.join(comp.select(F.col("node").alias(end), "component"), end, "left").withColumn(
            end, F.coalesce("component", end)).drop("component")
    over = sized(cut(components(links)))
    grown = comp.join(over.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select(
        "node", F.coalesce("whole", "component").alias("component"))
    return sized(cut(grown.union(over.join(comp.select("node"), "node", "left_anti"))))


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row, and ``n_copies`` (rows with an equal set),
    ``text_key`` and ``component`` (number of the class; null without shingles)."""
    prepare(docs.sparkSession)
    docs = id_text(docs)
    seen = cut(digest_sets(docs, heavy_shingles(docs, k), k, percent))
    # written once: the numbers given here stay
    nodes = cut(seen.filter("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.min("text_key").alias("text_key"), F.first("a").alias("a"), F.first("b").alias("b"),
        F.first("c").alias("c"), F.first("s").alias("s"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")).withColumn("nid", F.monotonically_increasing_id()))
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rows = shared_tokens(nodes).withColumn("band", band)

    def links_of(pairs: DataFrame) -> DataFrame:
        left = sized(cut(intersect_orders(sized(cut(pairs), small=False), nodes, percent)), small=False)
        ids = left.select(F.explode(F.array("x", "y")).alias("nid")).distinct()
        return sized(cut(verify(left, whole_sets(docs, cut(nodes.select("nid", "text_key").join(ids, "nid")), k), percent)))

    comp = sized(cut(components(links_of(hub_pairs(rows, nodes, percent)))))
    for propose in (near_pairs, rest_pairs):
        comp = join_components(comp, links_of(propose(rows, nodes, comp, percent, cell)))
    named = nodes.select("key", "nid", "doc_id", "n_copies").join(comp.select(F.col("node").alias("nid"), "component"), "nid", "left").withColumn(
        "component", F.coalesce("component", "nid"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("key", "component", "component_id", "n_copies")
    return seen.select("doc_id", F.col("n").alias("n_shingles"), "key", "text_key").join(named, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "text_key", "component")
