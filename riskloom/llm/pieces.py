"""SentencePiece encoding and decoding in vectorised merge rounds (operator 11).

A batch of texts is one flat array of symbols. Spaces become the space mark, each text that is not empty
gets one in front, and the array falls into words at every mark that follows something else (a model in
which a piece crosses such a place is refused). Equal words of a batch are merged once; a word whose hash
is that of another one is compared character by character before it shares that word's pieces.

A merge round works on all words at once: the lowest pair rank of each word (ranks follow the piece scores,
equal scores share a rank), the leftmost places that hold it, all of them merged together, then compaction;
words without a pair leave. Merging one place after the other, best score first and leftmost first, is what
the library does. A round gives the same: it stops within a word behind the first merge that makes a pair at
least as good as the one being merged, because that pair would come next. Runs of one symbol whose pieces
share the worst score (blank runs) are cut in one round into the pieces that merging from the left gives.

``encode`` returns the ids with begin and end id, ``decode`` the text of ids. Tables are built once on the
driver and broadcast; their size is that of the vocabulary. Rows never leave their task: no shuffle.

Null and empty texts encode to begin and end id and decode to the empty text; null ids decode to the empty
text, ids outside the vocabulary are an error as in the library. Rows that repeat are encoded each. An empty
table gives no rows. Columns other than those named are left out, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textvec as tv
from riskloom.llm.common import id_text, prepare

SPACE = "▁"
NONE = np.int32(2**31 - 1)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> dict:
    """Tables of a model file: BPE with byte pieces and text left as it is (no normalisation rules)."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (
            norm.add_dummy_prefix and norm.escape_whitespaces) or train.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: not a BPE model with byte pieces, identity rules and a space mark in front")
    out = tables([(p.piece, p.score, p.type) for p in model.pieces])
    return out | {"begin": train.bos_id, "end": train.eos_id, "unknown": train.unk_surface.encode()}


def tables(pieces: list[tuple[str, float, int]]) -> dict:
    """Plain arrays: characters, pairs with what they make and its rank, bytes of every id."""
    size = len(pieces)
    if any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for *_, t in pieces):
        raise ValueError("user-defined and unused pieces are not built")
    symbol = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
    if any(SPACE in p.lstrip(SPACE) for p in symbol):
        raise ValueError("a piece goes on after a word's end")
    worst_first = sorted({s for _, s, t in pieces if t == NORMAL}, reverse=True)
    rank_of = {s: i for i, s in enumerate(worst_first)}
    made = [(p, i, rank_of[s]) for i, (p, s, t) in enumerate(pieces) if t == NORMAL and len(p) > 1]
    # characters that stand only inside longer pieces are symbols too
    chars = {c for p, _, _ in made for c in p}
    for c in sorted(chars):
        symbol.setdefault(c, len(symbol) + size)
    pairs, bigrams = {}, set()
    for p, i, r in made:
        for k in range(1, len(p)):
            left, right = symbol.get(p[:k]), symbol.get(p[k:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = (i, r)
        bigrams.update((symbol[a] << 32 | symbol[b]) for a, b in zip(p, p[1:]))
    single = {ord(c): i for c, i in symbol.items() if len(c) == 1}
    char = np.full(max(single, default=0) + 2, -1, np.int64)
    char[list(single)] = list(single.values())
    keys, made_of = hashed({k: np.array(v) for k, v in pairs.items()}, 2)
    surface = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[3:-1], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in pieces]
    byte_id = np.zeros(256, np.int32)
    for i, (p, _, t) in enumerate(pieces):
        if t == BYTE:
            byte_id[int(p[3:-1], 16)] = i
    return {
        "size": size, "raw": 2 * size + len(symbol), "char": char, "char_of": {i: c for c, i in single.items()},
        "pair": keys, "pair_makes": made_of[:, 0].copy(), "pair_rank": made_of[:, 1].astype(np.int32),
        "bigram": hashed({k: np.zeros(0) for k in bigrams}, 0)[0], "type": np.array([t for *_, t in pieces], np.int8), "byte_id": byte_id,
        "marked": np.array([t == NORMAL and p.startswith(SPACE) for p, _, t in pieces], bool), "chain": _chain(made, symbol),
        "surface": np.frombuffer(b"".join(surface), np.uint8), "surface_len": np.array([len(s) for s in surface], np.int64)}


def _chain(made: list[tuple[str, int, int]], symbol: dict[str, int]):
    """(symbol, rank, ids by length, cuts) of the one character whose runs are all the pieces of the worst rank, no
    other piece having two of it in a row; ``cuts[r, o]`` is the length of the piece that starts at offset ``o`` of
    a run's last ``r`` symbols behind its longest pieces, or 0. None if there is no such character."""
    last = max((r for *_, r in made), default=0)
    at_last = [p for p, _, r in made if r == last]
    if not at_last or len({c for p in at_last for c in p}) != 1:
        return None
    c, ids = at_last[0][0], {len(p): i for p, i, r in made if r == last}
    if any(c + c in p and r != last for p, _, r in made):
        return None
    ids[1], most = symbol[c], max(ids)

    def split(n: int) -> list[int]:
        """The merges of a run one by one, leftmost first."""
        parts = [1] * n
        while i := next((i for i in range(1, len(parts)) if parts[i - 1] + parts[i] in ids), 0):
            parts[i - 1:i + 1] = [parts[i - 1] + parts[i]]
        return parts

    splits = [split(n) for n in range(3 * most)]
    if any(splits[n] != [most] + splits[n - most] for n in range(most, 3 * most)):
        return None
    cuts = np.zeros((most, most), np.int64)
    for r in range(most):
        cuts[r, np.cumsum([0] + splits[r])[:-1]] = splits[r]
    return symbol[c], last, np.array([ids.get(k, -1) for k in range(most + 1)], np.int64), cuts


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + size), one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


EMPTY = -1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def hashed(values: dict[int, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Open-addressed table: keys by slot and their values; a power of two of slots, at most a quarter full."""
    size = 1 << max(4, (4 * len(values)).bit_length())
    keys, out = np.full(size, EMPTY, np.int64), np.zeros((size, width), np.int64)
    order = sorted(values)
    for k, at in zip(order, _slots(np.array(order, np.int64), size).tolist()):
        while keys[at] != EMPTY:
            at = (at + 1) % size
        keys[at], out[at] = k, values[k]
    return keys, out


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the key there, its slot) of every key."""
    at = _slots(keys, len(table))
    there = table[at]
    ok = there == keys
    todo = np.flatnonzero(~ok & (there != EMPTY))
    while len(todo):
        at[todo] = (at[todo] + 1) & (len(table) - 1)
        there = table[at[todo]]
        ok[todo] = there == keys[todo]
        todo = todo[(there != keys[todo]) & (there != EMPTY)]
    return ok, at


def _find(t: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, made symbol) of pairs; rank NONE where there is no such piece."""
    ok, at = lookup(t["pair"], left << 32 | right)
    return np.where(ok, t["pair_rank"][at], NONE), t["pair_makes"][at]


def merge(t: dict, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words (flat, ``word`` ascending) merged until no pair remains, in rounds over all words."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    n = len(sym)
    rank, makes = np.full(n, NONE, np.int32), np.zeros(n, np.int64)
    fresh = np.arange(n - 1) if n else np.zeros(0, np.int64)
    while True:
        fresh = fresh[word[fresh] == word[fresh + 1]]
        if len(fresh):
            rank[fresh], makes[fresh] = _find(t, sym[fresh], sym[fresh + 1])
        if not len(sym):
            break
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(sym)))
        low = np.minimum.reduceat(rank, first)
        live = np.repeat(low < NONE, size)
        if not live.all():
            done.append((sym[~live], word[~live]))
            sym, word, rank, makes = sym[live], word[live], rank[live], makes[live]
            first, size, low = None, size[low < NONE], low[low < NONE]
            if not len(sym):
                break
        low = np.repeat(low, size)
        keep, changed = np.ones(len(sym), bool), np.zeros(len(sym), bool)
        chained = np.zeros(len(sym), bool)
        if t["chain"] is not None:
            c, worst, ids, cuts = t["chain"]
            chained = low == worst
            run = np.flatnonzero(chained & (sym == c))
            if len(run):
                head = np.flatnonzero(np.concatenate([[True], (np.diff(run) != 1) | (word[run[1:]] != word[run[:-1]])]))
                long = np.diff(np.append(head, len(run)))
                place = np.arange(len(run)) - np.repeat(head, long)
                most, rest = len(cuts), np.repeat(long % len(cuts), long)
                within = place % most
                takes = np.where(place < np.repeat(long, long) - rest, np.where(within == 0, most, 0), cuts[rest, within])
                sym[run] = ids[takes]
                keep[run[takes == 0]] = False
                changed[run] = True
        hit = (rank == low) & ~chained
        # places in a row overlap: every other one, from the left
        before = np.concatenate([[False], hit[:-1]])
        at = np.flatnonzero(hit)
        if len(at):
            head = np.flatnonzero(hit & ~before)
            odd = (at - head[np.searchsorted(head, at, "right") - 1]) & 1
            at = at[odd == 0]
            m, r, w = makes[at], rank[at], word[at]
            # neighbours as they stand when this place's turn comes: to its left merged, to its right not yet
            joined = np.concatenate([[False], at[1:] == at[:-1] + 2])
            left = np.where(joined, np.concatenate([[0], m[:-1]]), sym[np.maximum(at - 1, 0)])
            has = (at > 0) & (word[np.maximum(at - 1, 0)] == w)
            over = np.minimum(at + 2, len(sym) - 1)
            goes = (at + 2 < len(sym)) & (word[over] == w)
            better = (has & (_find(t, left, m)[0] <= r)) | (goes & (_find(t, m, sym[over])[0] <= r))
            if better.any():
                seen = np.cumsum(better) - better
                begin = np.searchsorted(w, w)
                at, m = (x[seen == seen[begin]] for x in (at, m))
            sym[at] = m
            keep[at + 1] = False
            changed[at] = True
        sym, word, rank, makes, changed = sym[keep], word[keep], rank[keep], makes[keep], changed[keep]
        # pairs of changed symbols and of those before them
        changed[:-1] |= changed[1:]
        rank[changed] = NONE
        fresh = np.flatnonzero(changed[:-1])
    if not done:
        return sym, word
    sym, word = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def _word_ids(t: dict, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number per word, of flat character symbols."""
    # two characters that stand side by side in no piece never come together
    apart = (word[1:] != word[:-1]) | ~lookup(t["bigram"], sym[:-1] << 32 | sym[1:])[0]
    opens = np.concatenate([[True], apart])[:len(sym)]
    part, owner = np.cumsum(opens) - 1, word[opens]
    out, part = merge(t, sym.copy(), part)
    word = owner[part]
    other = np.flatnonzero(out >= t["size"])
    count = np.ones(len(out), np.int64)
    if not len(other):
        return out, np.bincount(word, minlength=n_words)
    kinds, which = np.unique(out[other], return_inverse=True)
    spelt = [t["byte_id"][np.frombuffer(chr(k - t["raw"] if k >= t["raw"] else t["char_of"][k]).encode("utf-8", "surrogatepass"), np.uint8)] for k in kinds.tolist()]
    long = np.array([len(s) for s in spelt], np.int64)
    begin = np.cumsum(long) - long
    count[other] = long[which]
    ids = np.repeat(out, count)
    ids[ragged((np.cumsum(count) - count)[other], long[which])] = np.concatenate(spelt)[ragged(begin[which], long[which])]
    return ids, np.bincount(word, weights=count, minlength=n_words).astype(np.int64)


def _chunks(text: str, most: int) -> Iterator[str]:
    """A long text cut before spaces that open a word; the mark in front of a chunk stands for that space."""
    lo = 0
    while len(text) - lo > most:
        cut = lo + most
        while 0 < (cut := text.find(" ", cut)) < len(text) - 1 and text[cut - 1] in " " + SPACE:
            cut += 1
        if not 0 < cut < len(text) - 1:
            break
        yield text[lo:cut]
        lo = cut + 1
    yield text[lo:]


def _body(t: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of texts that are not empty, number of ids per text)."""
    size = np.array([len(x) + 1 for x in texts], np.int64)
    cps = np.frombuffer((SPACE + SPACE.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cps[cps == 0x20] = ord(SPACE)
    first = np.cumsum(size) - size
    mark = cps == ord(SPACE)
    opens = mark & ~np.concatenate([[False], mark[:-1]])
    opens[first] = True
    start = np.flatnonzero(opens)
    long = np.diff(np.append(start, len(cps)))
    p, q = tv._powers(len(cps))
    h = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(tv.mix(cps.astype(np.uint64) + tv.U(1)) * p[:len(cps)], out=h[1:])
    h = tv.mix((h[start + long] - h[start]) * q[start] + long.astype(np.uint64))
    _, rep, kind = np.unique(h, return_index=True, return_inverse=True)
    # equal hashes share pieces only if their characters are equal
    there = np.minimum(ragged(start[rep][kind], long), len(cps) - 1)
    same = (long[rep][kind] == long) & np.logical_and.reduceat(cps[there] == cps, start)
    if not same.all():
        alone = np.flatnonzero(~same)
        kind[alone] = len(rep) + np.arange(len(alone))
        rep = np.concatenate([rep, alone])
    chars = cps[ragged(start[rep], long[rep])]
    sym = t["char"][np.minimum(chars, len(t["char"]) - 1)]
    sym = np.where(sym < 0, t["raw"] + chars, sym)
    ids, count = _word_ids(t, sym, np.repeat(np.arange(len(rep)), long[rep]), len(rep))
    per_word = count[kind]
    doc = np.searchsorted(first, start, "right") - 1
    return ids[ragged((np.cumsum(count) - count)[kind], per_word)], np.bincount(doc, weights=per_word, minlength=len(texts)).astype(np.int64)


def encode_texts(t: dict, texts: list[str | None], most: int = tv.BATCH_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets): begin id, pieces, end id of each text."""
    parts = [(i, c) for i, x in enumerate(texts) if x for c in _chunks(x, most)]
    bodies, n_ids = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for lo, hi in tv.slices([len(c) for _, c in parts], most):
        ids, n = _body(t, [c for _, c in parts[lo:hi]])
        bodies.append(ids)
        np.add.at(n_ids, [i for i, _ in parts[lo:hi]], n)
    off = np.concatenate([[0], np.cumsum(n_ids + 2)])
    out = np.empty(int(off[-1]), np.int32)
    out[off[:-1]], out[off[1:] - 1] = t["begin"], t["end"]
    out[ragged(off[:-1] + 1, n_ids)] = np.concatenate(bodies)
    return out, off


def _byte_by_byte(e: UnicodeError):
    """Each byte that starts no character is one replacement character."""
    return "�", e.start + 1


def decode_ids(t: dict, ids: np.ndarray, off: np.ndarray) -> list[str]:
    """Texts of id lists: surfaces in a row, the space mark in front of a text's first piece dropped."""
    codecs.register_error("byte_by_byte", _byte_by_byte)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= t["size"]):
        raise ValueError("an id lies outside the vocabulary")
    start = np.cumsum(t["surface_len"]) - t["surface_len"]
    begin, size = start[ids], t["surface_len"][ids]
    kind = t["type"][ids]
    pool = t["surface"]
    if (unknown := kind == UNKNOWN).any():
        begin[unknown], size[unknown] = len(pool), len(t["unknown"])
        pool = np.concatenate([pool, np.frombuffer(t["unknown"], np.uint8)])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    spoken = np.flatnonzero(kind != CONTROL)
    head = spoken[np.concatenate([[True], doc[spoken[1:]] != doc[spoken[:-1]]])] if len(spoken) else spoken
    head = head[t["marked"][ids[head]]]
    begin[head] += 1
    size[head] -= 1
    raw = pool[ragged(begin, size)].tobytes()
    place = np.concatenate([[0], np.cumsum(size)])
    # bytes on both sides of a control id are no character together
    inner = np.flatnonzero((kind[1:-1] == CONTROL) & (doc[1:-1] == doc[:-2]) & (doc[1:-1] == doc[2:])) + 1
    breaks: dict[int, list[int]] = {}
    for i in inner.tolist():
        breaks.setdefault(int(doc[i]), []).append(int(place[i]))
    out = []
    for d, (a, b) in enumerate(zip(place[off[:-1]].tolist(), place[off[1:]].tolist())):
        at = [a, *breaks.get(d, ()), b]
        out.append("".join(raw[x:y].decode("utf-8", "byte_by_byte") for x, y in zip(at, at[1:])))
    return out


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, begin and end id included."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(load(model or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, off = encode_texts(held.value, _column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))],
                                             ["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text of every list of ids."""
    prepare(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(load(model or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _column(batch, "ids")
            size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            size = np.where(np.asarray(lists.is_valid()), size, 0)
            off = np.concatenate([[0], np.cumsum(size)])
            texts = decode_ids(held.value, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off)
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, ids array<int>, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids, text)."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _column(batch, "ids")
            off = lists.offsets.to_numpy().tolist() if len(lists) else [0]
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B") if len(lists.values) else b""
            n = [b - a for a, b in zip(off, off[1:])]
            sums = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(off, off[1:])]
            texts = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in _column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.select("doc_id", "ids", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
