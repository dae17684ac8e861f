"""Removal of repeated substrings through suffix-array shards (operator 8).

A byte is removed if a 400-byte string that covers it also starts anywhere else, in any text or place.

1. Every 400-byte string has one *anchor*: its leftmost smallest 128-byte rolling hash. Equal strings have
   equal anchors at equal places, so all occurrences of a string lie in the *contexts* (the bytes a string
   around it can reach) of the places that carry the same anchor hash. One pass over the texts emits anchors
   with a hash of their context; nothing else of the texts moves.
2. Anchors that occur once are dropped (nothing they anchor repeats). Equal contexts are one context with a
   count: each of their strings repeats, so they are removed whole; copies of any number cost one row.
3. Where an anchor has different contexts, one text of each is cut out and sorted into shards by anchor. A
   context is first trimmed to what some other context of its anchor can share with it (sorted left and right
   sides bound the reach); equal trimmed contexts are one with a count. Where one context is left
   for all, its strings repeat; otherwise a suffix array (induced sorting) with permuted common prefixes over the
   shard finds the strings that do.
4. An anchor with more than ``GROUP_CONTEXTS`` different contexts (a passage that very many different texts
   share) is not put into one shard: its strings are counted one by one by an aggregation, with the same result.
5. Removed ranges are merged per distinct text; a second pass cuts them out.

``words`` finds passages of that many words as well (runs of non-blanks, A-Z lower-cased) that occur anywhere
else, whatever their bytes: the same steps run over the texts' 64-bit word hashes, one symbol a word, in the same
passes over the texts; their ranges go from the first byte of the first word to the last byte of the last one.
They are reported (n_passages, n_passage_bytes) and, with ``cut_passages``, removed.

Null and empty texts have no bytes. Doc ids may be null or repeat; equal texts get equal results. Hashes are
64 bits (anchors, contexts) and 128 bits (texts). Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textvec as tv
from riskloom.llm.common import TEXT_HASH, bitmap, cut, id_text, in_bitmap, prepare
from riskloom.llm.suffix import common_prefixes, common_symbols, sort_names, suffix_array

SPAN = 400
GRAM = 128
WORD_GRAM = 16
SHARD_BYTES = 1 << 20
CONTEXT = ["kind", "h", "text_key", "n", "lo", "a", "data"]
GROUP_CONTEXTS = 8192
WORD_BYTES = 8
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Kind:
    """What a text is read as: its bytes, or the hashes of its words; spans and grams count its symbols."""

    name: str
    span: int
    gram: int
    unit: int  # bytes a symbol

    @property
    def reach(self) -> int:
        return self.span - self.gram


def kinds(span: int, gram: int, words: int | None) -> list[Kind]:
    return [Kind("bytes", span, gram, 1)] + ([Kind("words", words, max(1, min(WORD_GRAM, words // 2)), WORD_BYTES)] if words else [])


def symbols(data: bytes, unit: int) -> np.ndarray:
    """A 64-bit value for every symbol."""
    return tv._BYTE[np.frombuffer(data, np.uint8)] if unit == 1 else np.frombuffer(data, np.uint64)


def _prefix_sums(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = tv._powers(len(v) + 1)
    h = np.empty(len(v) + 1, np.uint64)
    h[0] = 0
    np.cumsum(v * p[:len(v)], out=h[1:])
    return h, q


def window_minima(key: np.ndarray, w: int) -> np.ndarray:
    """The least value of every window of ``w`` values, from minima of blocks to both sides."""
    n = len(key)
    blocks = np.concatenate([key, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def anchors(texts: list[bytes], span: int, gram: int, unit: int = 1) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: anchor hash, context hash and place of its anchors. The windows of a batch are looked through at
    once (values are compared by their upper 40 bits, as ``textvec.window_min_positions`` does); those that reach into another
    text are left out."""
    out = []
    reach = span - gram
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low24 = tv.U((1 << 24) - 1)
    for lo, hi in tv.slices([len(t) for t in texts]):
        part = texts[lo:hi]
        h, q = _prefix_sums(symbols(b"".join(part), unit))
        grams = tv.mix((h[gram:] - h[:-gram]) * q[:len(h) - gram]) if len(h) > gram else h[:0]
        size = np.array([len(t) // unit for t in part], np.int64)
        first = np.cumsum(size) - size
        fit = np.flatnonzero(size >= span)
        if not len(fit):
            out += [none] * len(part)
            continue
        if len(grams) <= 1 << 18:
            lows = window_minima((grams & ~low24) | np.arange(len(grams), dtype=np.uint64), reach + 1)
            count = size[fit] - span + 1
            starts, doc = ragged_groups(first[fit], count), np.repeat(fit, count)
            at = (lows[starts] & low24).astype(np.int64)
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
            at, doc = at[new], doc[new]
        else:  # longer arrays go text by text, which keeps them in the cache
            each = [tv.window_min_positions(grams[first[d]:first[d] + size[d] - gram + 1], reach + 1) + first[d] for d in fit]
            at, doc = np.concatenate(each), np.repeat(fit, [len(x) for x in each])
        pos = at - first[doc]
        a, b = np.maximum(0, pos - reach), np.minimum(size[doc], pos + span)
        ctx = tv.mix((h[first[doc] + b] - h[first[doc] + a]) * q[first[doc] + a] + ((b - a) * 1024 + pos - a).astype(np.uint64))
        found, edge = grams[at], np.searchsorted(doc, np.arange(len(part) + 1))
        out += [(found[x:y], ctx[x:y], pos[x:y]) for x, y in zip(edge, edge[1:])]
    return out


def word_bytes(texts: list[bytes]) -> list[bytes]:
    """The texts as the hashes of their words, ``WORD_BYTES`` each."""
    return [h.tobytes() for h, _, _ in tv.batch_words(texts, tv.SPACE_SEP)]


def read_as(texts: list[bytes], kind: Kind) -> list[bytes]:
    return texts if kind.unit == 1 else word_bytes(texts)


def first_pass(docs: DataFrame, how: list[Kind]) -> DataFrame:
    """doc_id, text_key, n_bytes, sha256 of the whole text, and for each kind its length and anchors as arrays."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [tv.to_bytes(t) for t in pdf["text"].tolist()]
            out = {"doc_id": pdf["doc_id"].astype("Int64"), "text_key": [tv.digest16(t) for t in texts], "n_bytes": [len(t) for t in texts],
                   "sha": [hashlib.sha256(t).hexdigest() for t in texts]}
            for kind in how:
                read = read_as(texts, kind)
                got = anchors(read, kind.span, kind.gram, kind.unit)
                out |= {f"{kind.name}_n": [len(t) // kind.unit for t in read], f"{kind.name}_h": [tv.signed(g[0]) for g in got],
                        f"{kind.name}_ctx": [tv.signed(g[1]) for g in got], f"{kind.name}_pos": [g[2] for g in got]}
            yield pd.DataFrame(out)

    more = "".join(f", {k.name}_n long, {k.name}_h array<long>, {k.name}_ctx array<long>, {k.name}_pos array<long>" for k in how)
    return docs.mapInPandas(run, "doc_id long, text_key binary, n_bytes long, sha string" + more)


def live_anchors(seen: DataFrame, kind: Kind) -> DataFrame:
    """(h, ctx, text_key, size, pos, various) of anchors of a kind that occur more than once."""
    spark = seen.sparkSession
    seen = seen.select("text_key", *[F.col(f"{kind.name}_{c}").alias(x) for c, x in (("n", "size"), ("h", "h"), ("ctx", "ctx"), ("pos", "pos"))])
    count = seen.select(F.explode(F.arrays_zip("h", "ctx")).alias("x")).groupBy("x.h").agg(
        F.count("*").alias("n"), F.min("x.ctx").alias("c0"), F.max("x.ctx").alias("c1"))
    count = cut(count.filter("n > 1").select("h", (F.col("c0") != F.col("c1")).alias("various")))
    held = spark.sparkContext.broadcast(bitmap(count.select("h")))

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [len(x) for x in pdf["h"]]
            h, ctx, pos = (np.concatenate(pdf[c].to_list()).astype(np.int64) if len(pdf) else np.zeros(0, np.int64) for c in ("h", "ctx", "pos"))
            ok = in_bitmap(held.value, h.view(np.uint64))
            at = np.repeat(np.arange(len(pdf)), sizes)[ok]
            yield pd.DataFrame({"h": h[ok], "ctx": ctx[ok], "pos": pos[ok], "text_key": pdf["text_key"].to_numpy()[at],
                                "size": pdf["size"].to_numpy()[at]})

    rows = seen.filter(F.size("h") > 0).select("h", "ctx", "pos", "text_key", "size").mapInPandas(
        thin, "h long, ctx long, pos long, text_key binary, size long")
    return cut(rows.join(count, "h"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text_key, text) once for each wanted text_key; a fixed-size bit set thins the pass, an equi-join is exact."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.expr(TEXT_HASH))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[bytes] = set()
        for pdf in batches:
            texts = [tv.to_bytes(t) for t in pdf["text"].tolist()]
            keys = [tv.digest16(t) for t in texts]
            some = np.flatnonzero(in_bitmap(held.value, np.array([int.from_bytes(x[:8], "big") for x in keys], np.uint64))) if keys else []
            some = [i for i in some if keys[i] not in sent]
            if len(sent) < 100_000:  # copies next to each other are sent once; the rest is dropped below
                sent.update(keys[i] for i in some)
            yield pd.DataFrame({"text_key": [keys[i] for i in some], "text": [texts[i] for i in some]})

    # one row per text before the join: the exchange by text_key serves both
    return docs.select("text").mapInPandas(run, "text_key binary, text binary").dropDuplicates(["text_key"]).join(wanted, "text_key")


def contexts(docs: DataFrame, places: DataFrame, how: list[Kind]) -> DataFrame:
    """Cut out the context of each place (kind, h, text_key, pos, n): adds where it starts (lo), the anchor in it (a)
    and the bytes of its symbols."""
    wanted = cut(places.groupBy("text_key").agg(F.collect_set(F.struct("kind", "h", "pos", "n")).alias("at")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, at in zip(pdf["text_key"], pdf["text"], pdf["at"]):
                read: dict[int, bytes] = {}
                for x in at:
                    i, kind = x["kind"], how[x["kind"]]
                    if i not in read:
                        read[i] = read_as([t], kind)[0]
                    lo = max(0, x["pos"] - kind.reach)
                    rows.append((i, x["h"], k, x["n"], lo, x["pos"] - lo, read[i][lo * kind.unit:(x["pos"] + kind.span) * kind.unit]))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=CONTEXT)
                        rows = []
            yield pd.DataFrame(rows, columns=CONTEXT)

    got = texts_of(docs, wanted)
    return got.select("text_key", "text", "at").mapInPandas(run, "kind int, h long, text_key binary, n long, lo long, a int, data binary")


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix: the lowest bit in which the two differ as numbers."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "little") ^ int.from_bytes(y[:n], "little")
    return n if not differ else ((differ & -differ).bit_length() - 1) >> 3


def _reach(sides: list[bytes]) -> list[int]:
    """For each string the longest prefix it shares with any other: its neighbours in sorted order decide."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    both = [0, *(_common(sides[i], sides[j]) for i, j in zip(order, order[1:])), 0]
    out = [0] * len(sides)
    for i, p, q in zip(order, both, both[1:]):
        out[i] = max(p, q)
    return out


def trim(h: np.ndarray, at: list[int], n: list[int], data: list[bytes], span: int, gram: int, unit: int = 1) -> tuple[list, list, list, list, list]:
    """Contexts (rows sorted by anchor) cut to what another context of the anchor can share.

    Returns (row, start in the context, bytes, count) of each different trimmed context and, per input row, which
    of them it is (-1: no string of it can repeat).
    """
    rows, starts, parts, counts = [], [], [], []
    of = [-1] * len(data)
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else []
    for lo, hi in zip(edge, edge[1:]):
        if hi - lo < 2 and n[lo] < 2:
            continue
        left = _reach([data[i][at[i] * unit - 1::-1] if at[i] else b"" for i in range(lo, hi)])
        right = _reach([data[i][(at[i] + gram) * unit:] for i in range(lo, hi)])
        seen: dict[tuple[int, bytes], int] = {}
        for i, p, q in zip(range(lo, hi), left, right):
            p, q = p // unit, q // unit
            if p + gram + q < span:
                continue
            part = data[i][(at[i] - p) * unit:(at[i] + gram + q) * unit]
            x = seen.get((p, part))
            if x is None:
                x = seen[p, part] = len(rows)
                rows.append(i), starts.append(at[i] - p), parts.append(part), counts.append(0)
            counts[x] += n[i]
            of[i] = x
    return rows, starts, parts, counts, of


def shard_repeats(keys: list[bytes], lo: np.ndarray, n: np.ndarray, data: list[bytes], span: int, unit: int = 1) -> tuple[list, list, list]:
    """Ranges (context, from, to) of one shard's contexts that strings of ``span`` symbols repeating in it cover."""
    if not data:
        return [], [], []
    sizes = np.array([len(d) // unit for d in data], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    owner = np.repeat(np.arange(len(data), dtype=np.int32), sizes + 1)
    inner = np.arange(len(owner), dtype=np.int32) - begin.astype(np.int32)[owner]
    rest = sizes.astype(np.int32)[owner] - inner
    if unit == 1:
        raw = np.frombuffer(b"\x00".join(data) + b"\x00", np.uint8)
        t = raw.astype(np.uint16) + 2
        t[begin + sizes] = 1
        sa = suffix_array(np.append(t, 0), 258)[1:]
        lcp = common_prefixes(raw, sa, rest, span)
    else:
        # words are numbered; the string of numbers is sorted as strings of names are
        t = np.ones(len(owner), np.int64)
        t[rest > 0] = pd.factorize(np.frombuffer(b"".join(data), np.uint64), sort=True)[0] + 2
        sa = sort_names(np.append(t, 0))[1:]
        lcp = common_symbols(t, sa, rest, span)
    sa = sa[rest[sa] >= span]
    if not len(sa):
        return [], [], []
    # a class: neighbours in suffix order that share the whole string
    new = lcp[sa] < span
    new[0] = True
    edge, which = np.flatnonzero(new), np.cumsum(new) - 1
    text_no = pd.factorize(pd.Series(keys))[0]
    place = text_no[owner[sa]].astype(np.int64) << 40 | lo[owner[sa]] + inner[sa]
    # the same place seen from two contexts is one occurrence; a context that stands for several is several
    repeats = (np.minimum.reduceat(place, edge) != np.maximum.reduceat(place, edge)) | (np.maximum.reduceat(n[owner[sa]], edge) > 1)
    start = np.sort(sa[repeats[which]])
    if not len(start):
        return [], [], []
    own = owner[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(start) > span) | (np.diff(own) != 0)]))
    last = np.append(new[1:], len(start)) - 1
    return own[new].tolist(), inner[start[new]].tolist(), (inner[start[last]] + span).tolist()


def ragged_groups(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Row numbers of groups given by their first row and size."""
    end = np.cumsum(size)
    return (np.repeat(first - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)).astype(np.int64)


def shard_spans(rows: DataFrame, kind: Kind, shard_bytes: int) -> DataFrame:
    """Repeated ranges from suffix arrays over shards of whole anchor groups."""
    span, gram, unit = kind.span, kind.gram, kind.unit

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, lo = pdf["text_key"].to_numpy(), pdf["lo"].to_numpy(np.int64)
        row, start, data, count, of = trim(pdf["h"].to_numpy(np.int64), pdf["a"].tolist(), pdf["n"].tolist(), pdf["data"].tolist(), span, gram, unit)
        row, start = np.array(row, np.int64), np.array(start, np.int64)
        found: dict[int, list] = {}
        count, group = np.array(count, np.int64), pdf["h"].to_numpy(np.int64)[row]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(group)))
        # one context left that stands for several: all its strings repeat, there is nothing to sort
        alone = (size == 1) & (count[edge] > 1) if len(edge) else np.zeros(0, bool)
        for x in edge[alone].tolist():
            found[x] = [(0, len(data[x]) // unit)]
        # whole groups to each suffix array, near shard_bytes at a time
        rest = ragged_groups(edge[~alone], size[~alone])
        parts, group = [data[x] for x in rest.tolist()], group[rest]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        for p, q in tv.slices([int(total[b] - total[a]) for a, b in zip(edge, np.append(edge[1:], len(group)))], shard_bytes):
            a, b = edge[p], edge[q] if q < len(edge) else len(group)
            some = rest[a:b]
            for x, i, j in zip(*shard_repeats([keys[r] for r in row[some]], (lo[row] + start)[some], count[some], parts[a:b], span, unit)):
                found.setdefault(int(some[x]), []).append((i, j))
        # the anchor's place in the trimmed context puts the ranges into every context it stands for
        anchor = pdf["a"].to_numpy(np.int64)
        before = anchor[row] - start
        out = [(keys[i], int(lo[i] + anchor[i] - before[x] + a), int(lo[i] + anchor[i] - before[x] + b))
               for i, x in enumerate(of) if x >= 0 for a, b in found.get(x, ())]
        return pd.DataFrame(out, columns=["text_key", "lo", "hi"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += sum(map(len, pdf["data"]))
            if size >= 2 * shard_bytes:
                whole = pd.concat(held)
                open_group = whole["h"] == whole["h"].iloc[-1]
                if not open_group.all():  # the last group may go on in the next batch
                    yield shard(whole[~open_group])
                    held = [whole[open_group]]
                    size = sum(map(len, held[0]["data"]))
        if held:
            yield shard(pd.concat(held))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "h").sortWithinPartitions("h").select("h", "text_key", "n", "lo", "a", "data").mapInPandas(
        run, "text_key binary, lo long, hi long")


def counted_spans(rows: DataFrame, kind: Kind) -> DataFrame:
    """The same ranges by counting every string of the contexts: for anchors with too many contexts for one shard."""
    span, unit = kind.span, kind.unit

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s, where, key, at, n = [], [], [], [], []
            for k, lo, c, d in zip(pdf["text_key"], pdf["lo"], pdf["n"], pdf["data"]):
                h, q = _prefix_sums(symbols(d, unit))
                m = len(d) // unit - span + 1
                s.append(tv.mix((h[span:] - h[:m]) * q[:m]))
                at.append(lo + np.arange(m))
                where.append(tv.mix(at[-1].astype(np.uint64) * tv._R + tv.U(int.from_bytes(k[:8], "big"))))
                key += [k] * m
                n.append(np.full(m, c))
            if s:
                yield pd.DataFrame({"s": tv.signed(np.concatenate(s)), "place": tv.signed(np.concatenate(where)), "text_key": key,
                                    "lo": np.concatenate(at), "n": np.concatenate(n)})

    strings = rows.select("text_key", "lo", "n", "data").mapInPandas(run, "s long, place long, text_key binary, lo long, n long")
    twice = strings.groupBy("s").agg(F.min("place").alias("p0"), F.max("place").alias("p1"), F.max("n").alias("m")).filter("p0 <> p1 OR m > 1")
    return strings.join(twice.select("s"), "s").select("text_key", "lo", (F.col("lo") + span).alias("hi"))


def repeated_ranges(docs: DataFrame, seen: DataFrame, how: list[Kind], shard_bytes: int, group_contexts: int) -> list[DataFrame]:
    """For each kind (text_key, ranges): merged ranges of its symbols that repeat, per distinct text that has any."""
    whole, differ = [], []
    for i, kind in enumerate(how):
        live = live_anchors(seen, kind)
        same = cut(live.groupBy("h", "ctx", "various").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "pos")).alias("one")))
        whole.append(live.join(same.filter("n > 1").select("h", "ctx"), ["h", "ctx"]).select(
            "text_key", F.greatest(F.lit(0), F.col("pos") - kind.reach).alias("lo"), F.least("size", F.col("pos") + kind.span).alias("hi")).distinct())
        differ.append(same.filter("various").select(F.lit(i).alias("kind"), "h", "n", "one.text_key", "one.pos"))
    places = differ[0]
    for more in differ[1:]:
        places = places.union(more)
    crowded = cut(places.groupBy("kind", "h").count().filter(F.col("count") > group_contexts).select("kind", "h", F.lit(True).alias("crowded")))
    cuts = cut(contexts(docs, places, how).join(crowded, ["kind", "h"], "left"))
    some = {r.kind for r in crowded.select("kind").distinct().collect()}

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rows in pdf["raw"]:
                x = np.array(sorted((r["lo"], r["hi"]) for r in rows), np.int64)
                high = np.maximum.accumulate(x[:, 1])
                new = np.flatnonzero(np.concatenate([[True], x[1:, 0] > high[:-1]]))
                out.append([{"lo": int(a), "hi": int(b)} for a, b in zip(x[new, 0], high[np.append(new[1:], len(x)) - 1])])
            yield pd.DataFrame({"text_key": pdf["text_key"], "ranges": out})

    result = []
    for i, kind in enumerate(how):
        mine = cuts.filter(F.col("kind") == i)
        found = whole[i].union(shard_spans(mine.filter("crowded IS NULL"), kind, shard_bytes))
        if i in some:
            found = found.union(counted_spans(mine.filter("crowded"), kind))
        result.append(cut(found.groupBy("text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("raw")).mapInPandas(
            merge, "text_key binary, ranges array<struct<lo:long,hi:long>>")))
    return result


def _passage_bytes(t: bytes, passages) -> list[tuple[int, int]]:
    """Byte ranges of ranges of words."""
    if passages is None or not len(passages):
        return []
    _, start, end = tv.word_hashes(t, tv.SPACE_SEP)
    return [(int(start[r["lo"]]), int(end[r["hi"] - 1])) for r in passages]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _whole_characters(t: bytes, ranges) -> str:
    """The text without the characters that lie wholly in the ranges (the others stay whole)."""
    keep, at = [], 0
    for lo, hi in ranges:
        while lo < hi and t[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(t) and t[hi] & 0xC0 == 0x80:
            hi -= 1
        keep.append(t[at:lo])
        at = max(at, hi)
    return b"".join([*keep, t[at:]]).decode("utf-8", "replace")


def remove(docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
           group_contexts: int = GROUP_CONTEXTS, with_text: bool = False, words: int | None = None, cut_passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row; ``with_text`` adds text_key and, for texts that
    lost something, kept_text (characters that lie wholly in a removed range are gone). ``words`` adds n_passages
    and n_passage_bytes, the runs and bytes of passages of that many words that occur anywhere else; with
    ``cut_passages`` they are removed too."""
    prepare(docs.sparkSession)
    docs = id_text(docs)
    how = kinds(span, gram, words)
    seen = cut(first_pass(docs, how))
    ranges, *more = repeated_ranges(docs, seen, how, shard_bytes, group_contexts)
    size = seen.select("text_key", "n_bytes").distinct()
    known = ranges.join(size, "text_key").withColumn("all", (F.size("ranges") == 1) & (F.col("ranges")[0]["hi"] - F.col("ranges")[0]["lo"] == F.col("n_bytes")))
    if more:
        known = known.join(more[0].withColumnRenamed("ranges", "passages"), "text_key", "full").withColumn(
            "all", F.coalesce("all", F.lit(False)) & F.col("passages").isNull())
    else:
        known = known.withColumn("passages", F.lit(None).cast("array<struct<lo:long,hi:long>>"))
    known = cut(known)

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, bytes_, words_ in zip(pdf["text_key"], pdf["text"], pdf["ranges"], pdf["passages"]):
                gone_ = [(r["lo"], r["hi"]) for r in (() if bytes_ is None else bytes_)]
                passages = _merged(_passage_bytes(t, words_))
                if cut_passages:
                    gone_ = _merged(gone_ + passages)
                sha, at, gone = hashlib.sha256(), 0, 0
                for lo, hi in gone_:
                    sha.update(t[at:lo])
                    at = hi
                    gone += hi - lo
                sha.update(t[at:])
                rows.append((k, gone, len(gone_), sha.hexdigest(), _whole_characters(t, gone_) if with_text and gone_ else None,
                             len(passages), sum(hi - lo for lo, hi in passages)))
            yield pd.DataFrame(rows, columns=["text_key", "n_removed", "n_spans", "kept", "kept_text", "n_passages", "n_passage_bytes"])

    schema = "text_key binary, n_removed long, n_spans long, kept string, kept_text string, n_passages long, n_passage_bytes long"
    part = texts_of(docs, known.filter("NOT all").select("text_key", "ranges", "passages")).mapInPandas(cut_out, schema)
    none = F.lit(0).cast("long")
    full = known.filter("all").select("text_key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                                      F.lit(EMPTY).alias("kept"), F.lit("").alias("kept_text"), none.alias("n_passages"), none.alias("n_passage_bytes"))
    out = seen.select("doc_id", "text_key", "n_bytes", "sha").join(part.union(full), "text_key", "left")
    adds = (["n_passages", "n_passage_bytes"] if words else [])
    return out.select("doc_id", "n_bytes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ["n_removed", "n_spans", *adds]],
                      F.coalesce("kept", "sha").alias("kept_sha256"), *(["text_key", "kept_text"] if with_text else []))
