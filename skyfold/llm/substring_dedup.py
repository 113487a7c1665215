"""Removal of long passages that repeat across documents, by FM-indexes.

A window is ``WIDTH`` consecutive words.  A word goes if a window over it also
starts in a document with a smaller doc_id; windows are judged on the input.

Streaming every document over the index of every other part of the corpus would
be quadratic.  Instead, windows meet in shards by content.  A window's least
hash of ``GRAM`` consecutive words (its minimizer) depends on its words only, so
equal windows have equal minimizers; consecutive windows with one minimizer form
a segment, some 23 windows long.  Minimizers that occur in one document only
cannot belong to a repeated window and end there: what moves on is the shared
part of the corpus.  Equal segments collapse to one content with its smallest
doc_id, by a map-side aggregate, so a group of copies with a third of all rows
is indexed once.

A minimizer whose contents are many (a passage that a third of all documents
hold in ever new variants) is thinned before that.  Its contents are dealt into
groups of about ``GROUP``; the windows of a group are counted where they are, by
hash, and each distinct one moves on as one row, so a passage costs a group its
own length and not that of all who hold it.  Windows seen twice in all groups
return to each group that has them, and contents are cut to the runs of those.
What is left of near copies are stretches of the common passage, which collapse
again, so the contents of a minimizer grow with the repeated text and not with
the documents that hold it.

The contents of a shard are cut in the same way, in the task that holds them: a
window whose hash stands once in the shard has one holder, its own content.  The
distinct stretches that are left are indexed by a compressed FM-index and
searched backwards in it.  The matching statistics at ``WIDTH`` give, for each
window, the class of all its occurrences and so the smallest doc_id among them;
runs of windows with one answer are the intervals that are reported.  Hashes of
windows only spare the index windows that occur once; equal hashes of different
windows put them into the index, which tells them apart.  An index takes about
``SHARD_WORDS`` words, cut between minimizers.  A minimizer with more shared
contents than that is indexed in parts and its windows are searched in each
part: an index keeps its size, but the contents of one minimizer are held by one
task.

Intervals return to their documents by doc_id and a hash of the text.

Defined results: a null or blank text has no words; documents under ``WIDTH``
words keep all; rows that repeat a doc_id are one document (no smaller id), each
judged by its own text; a null doc_id is neither smaller nor larger than others
and keeps all; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm import textnp
from skyfold.llm.fm_index import FMIndex
from skyfold.llm.session import bound_batches, discard, materialise

WIDTH = 50
GRAM = 8
SHARD_WORDS = 1_500_000
#: A minimizer with more contents than this is thinned first.
CROWD = 64
#: Contents of a crowded minimizer whose windows are counted together.
GROUP = 4096
#: Words of groups whose windows are counted at once.
COUNT_WORDS = 1 << 19
#: Windows of a piece that one search goes through: all searches of a shard step together.
STRIDE = 128
U = np.uint64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:]) if len(x) > done else x[:0]
        done *= 2
    rest = width - done
    return (np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x


def span_hashes(w: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the words from ``first`` up to ``last`` of each span."""
    power, inverse = textnp._powers(len(w) + 1)
    out = []
    for v in (w, textnp.mix64(w ^ U(0x5851F42D4C957F2D))):
        sums = np.zeros(len(w) + 1, U)
        np.cumsum(v * power[: len(w)], out=sums[1:])
        out.append(textnp.mix64((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U)).view(np.int64))
    return out


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of all ``k`` consecutive words, over the borders of texts too."""
    power, inverse = textnp._powers(len(w) + 1)
    sums = np.zeros(len(w) + 1, U)
    np.cumsum(w * power[: len(w)], out=sums[1:])
    return textnp.mix64((sums[k:] - sums[:-k]) * inverse[: max(0, len(w) - k + 1)])


def segments(texts: list, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """All segments of ``texts``: text number, first word, windows, minimizer and two hashes of the words."""
    w, at = textnp.word_hashes(texts, lower=False)
    m = sliding_min(gram_hashes(w, gram), width - gram + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    n = len(m)
    if not n:
        none = np.zeros(0, np.int64)
        return {k: none for k in ("text", "start", "windows", "key", "c1", "c2")}
    within = owner[:n] == owner[width - 1 : width - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (m[1:] != m[:-1]) | (owner[1:n] != owner[: n - 1]) | ~within[:-1]
    first = np.flatnonzero(new & within)
    # A segment ends where the next begins or the text has no more windows.
    stop = at[1:][owner[first]] - width + 1
    nxt = np.append(first[1:], n)
    end = np.minimum(nxt, stop)
    last = end + width - 1
    out = {"text": owner[first], "start": first - at[owner[first]], "windows": end - first, "key": m[first].view(np.int64)}
    out["c1"], out["c2"] = span_hashes(w, first, last)
    return out


def _segments(batches):
    for pdf in batches:
        texts = [x if isinstance(x, str) else None for x in pdf["text"].tolist()]
        ids, th = pdf["doc_id"].to_numpy(), pdf["th"].to_numpy()
        for a, b in textnp.blocks(texts):
            s = segments(texts[a:b])
            row = a + s["text"]
            yield pd.DataFrame({"key": s["key"], "c1": s["c1"], "c2": s["c2"], "doc_id": ids[row], "th": th[row], "start": s["start"].astype(np.int32), "windows": s["windows"].astype(np.int32)})


def _contents(batches):
    """Documents with the segments that they are asked for -> the words of those."""
    for pdf in batches:
        texts = [x if isinstance(x, str) else None for x in pdf["text"].tolist()]
        wanted = pdf["wanted"].tolist()
        for a, b in textnp.blocks(texts):
            w, at = textnp.word_hashes(texts[a:b], lower=False)
            raw = w.astype(U).tobytes()
            rows = []
            for d in range(a, b):
                base = int(at[d - a])
                for s in wanted[d]:
                    i = (base + s["start"]) * 8
                    rows.append((s["key"], s["c1"], s["c2"], s["least"], raw[i : i + (s["windows"] + WIDTH - 1) * 8]))
            yield pd.DataFrame(rows, columns=["key", "c1", "c2", "least", "words"])


def window_hashes(pieces: list[np.ndarray], width: int = WIDTH) -> np.ndarray:
    """A hash of each window of ``pieces``, piece after piece; no piece is shorter than a window."""
    if not pieces:
        return np.zeros(0, np.int64)
    own = np.ones(sum(len(p) for p in pieces), bool)
    ends = np.cumsum([len(p) for p in pieces])
    for k in range(1, width):
        own[ends - k] = False
    return gram_hashes(np.concatenate(pieces), width)[own[: len(own) - width + 1]].view(np.int64)


def stretches(shared: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of shared windows of pieces with so many windows each: piece, first window, last window plus one."""
    edge = np.zeros(len(shared) + 1, bool)
    at = np.concatenate([[0], np.cumsum(counts)])
    edge[at] = True
    before, after = np.append(False, shared[:-1]), np.append(shared[1:], False)
    a = np.flatnonzero(shared & (~before | edge[:-1]))
    b = np.flatnonzero(shared & (~after | edge[1:])) + 1
    piece = np.searchsorted(at, a, "right") - 1
    return piece, a - at[piece], b - at[piece]


def _searched(pieces: list[np.ndarray], least: np.ndarray, width: int, shard_words: int) -> list[np.ndarray]:
    """For each window of pieces that meet nothing else: the least of ``least`` over all pieces that hold it, by search in their FM-index."""
    lengths = np.array([len(p) for p in pieces])
    parts, size = [[]], 0
    for k, n in enumerate(lengths):
        if size + n > shard_words and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append(k)
        size += n + 1
    best = [np.full(n - width + 1, np.iinfo(np.int64).max) for n in lengths]
    for part in parts:
        own = np.concatenate([pieces[k] for k in part])
        alphabet, codes = np.unique(own, return_inverse=True)
        ends = np.cumsum(lengths[part] + 1)
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        place = np.arange(len(own)) + np.repeat(np.arange(len(part)), lengths[part])
        text[place] = codes + 1
        holder = np.full(len(text), np.iinfo(np.int64).max)
        holder[place] = np.repeat(least[part], lengths[part])
        index = FMIndex(text, width, holder)
        minima = index.minima
        if len(parts) == 1:
            flat = np.concatenate(best)
            counts = lengths - width + 1
            offset = np.concatenate([[0], np.cumsum(counts)[:-1]])
            searches = -(-counts // STRIDE)
            piece = np.repeat(np.arange(len(counts)), searches)
            first = (np.arange(len(piece)) - np.repeat(np.cumsum(searches) - searches, searches)) * STRIDE
            n = np.minimum(STRIDE, counts[piece] - first) + width - 1
            for k, at, c in index.own_windows(text, (ends - 1 - lengths)[piece] + first + n, n):
                flat[offset[piece[k]] + first[k] + at] = minima[c]
            best = np.split(flat, offset[1:])
        else:
            for k, p in enumerate(pieces):
                found = np.searchsorted(alphabet, p)
                found = np.where(alphabet[np.minimum(found, len(alphabet) - 1)] == p, found + 1, 0)
                c = index.find_windows(np.lib.stride_tricks.sliding_window_view(found, width))
                best[k] = np.where(c >= 0, np.minimum(best[k], minima[c]), best[k])
    return best


def _runs(rows: list[tuple], width: int = WIDTH, shard_words: int = SHARD_WORDS):
    """For contents (c1, c2, least doc, words) that meet nothing outside ``rows``: runs (first, end, least doc of all holders) of their windows."""
    pieces = [np.frombuffer(r[3], U) for r in rows]
    counts = np.array([len(p) for p in pieces]) - width + 1
    h = window_hashes(pieces, width)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(h), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    best = np.repeat(np.array([r[2] for r in rows], np.int64), counts)
    # Equal stretches are indexed once.
    which, least, each = {}, [], []
    for k, a, b in zip(*(x.tolist() for x in stretches(shared, counts))):
        n = which.setdefault(rows[k][3][a * 8 : (b + width - 1) * 8], len(which))
        each.append(n)
        if n == len(least):
            least.append(rows[k][2])
        elif rows[k][2] < least[n]:
            least[n] = rows[k][2]
    if each:
        found = _searched([np.frombuffer(x, U) for x in which], np.array(least, np.int64), width, shard_words)
        best[shared] = np.concatenate([found[n] for n in each])
    at = np.concatenate([[0], np.cumsum(counts)])
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[at[:-1]] = True
    cut = np.flatnonzero(new)
    least, end, run = best[cut], np.append(cut[1:], len(best)), np.searchsorted(cut, at)
    for r, o, a, b in zip(rows, at.tolist(), run[:-1].tolist(), run[1:].tolist()):
        yield r[0], r[1], cut[a:b] - o, end[a:b] - o, least[a:b]


def _shards(batches):
    """A partition's contents, sorted by minimizer, cut into shards between minimizers."""

    def out(rows):
        got = list(_runs(rows))
        return pd.DataFrame({"c1": [g[0] for g in got], "c2": [g[1] for g in got], "first": [g[2].astype(np.int32) for g in got], "end": [g[3].astype(np.int32) for g in got], "least": [g[4] for g in got]})

    rows, size, key = [], 0, None
    for pdf in batches:
        for k, c1, c2, least, words in zip(pdf["key"].tolist(), pdf["c1"].tolist(), pdf["c2"].tolist(), pdf["least"].tolist(), pdf["words"]):
            if size >= SHARD_WORDS and k != key:
                yield out(rows)
                rows, size = [], 0
            rows.append((c1, c2, least, words))
            size += len(words) // 8
            key = k
    if rows:
        yield out(rows)


def _windows(batches):
    """Contents sorted by group -> each distinct window of a group and the number of its places; a group over two blocks gives some twice."""

    def out(blocks):
        pieces = [x for b in blocks for x in b[2]]
        counts = [len(x) - WIDTH + 1 for x in pieces]
        w = window_hashes(pieces)
        key, part = (np.repeat(np.concatenate([b[k] for b in blocks]), counts) for k in (0, 1))
        order = np.lexsort((w, part, key))
        w, key, part = w[order], key[order], part[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        return pd.DataFrame({"key": key[first], "part": part[first], "w": w[first], "n": np.diff(np.append(first, len(w)))})

    blocks, size = [], 0
    for pdf in batches:
        blocks.append((pdf["key"].to_numpy(), pdf["part"].to_numpy(), [np.frombuffer(x, U) for x in pdf["words"]]))
        size += sum(len(x) for x in blocks[-1][2])
        if size >= COUNT_WORDS:
            yield out(blocks)
            blocks, size = [], 0
    if blocks:
        yield out(blocks)


def _cut(batches):
    """Groups, their shared windows first -> the runs of those in their contents, as contents of their own with where they come from."""
    marks = np.zeros(0, np.int64)
    for pdf in batches:
        # A window that another group shares is shared too: all groups of a batch are looked up together, the last one may go on.
        given = [x for x in pdf["marks"] if x is not None]
        held = np.unique(np.concatenate([marks, *given]).astype(np.int64))
        marks = given[-1] if given else marks
        rows = pdf[pdf["words"].notna()]
        raw = rows["words"].tolist()
        pieces = [np.frombuffer(x, U) for x in raw]
        counts = np.array([len(p) - WIDTH + 1 for p in pieces], np.int64)
        h = window_hashes(pieces)
        place = np.minimum(np.searchsorted(held, h), max(0, len(held) - 1))
        piece, a, b = stretches(held[place] == h if len(held) else np.zeros(len(h), bool), counts)
        b = b + WIDTH - 1
        at = np.concatenate([[0], np.cumsum(counts + WIDTH - 1)])[piece]
        h1, h2 = span_hashes(np.concatenate(pieces) ^ U(0xA5A5A5A5A5A5A5A5), at + a, at + b) if pieces else (h, h)
        out = {c: rows[c].to_numpy()[piece] for c in ("key", "c1", "c2")}
        parts = [raw[k][i * 8 : j * 8] for k, i, j in zip(piece.tolist(), a.tolist(), b.tolist())]
        yield pd.DataFrame(out | {"shift": a.astype(np.int32), "h1": h1, "h2": h2, "least": rows["least"].to_numpy()[piece], "words": parts})


def thinned(crowd: DataFrame) -> DataFrame:
    """Contents (key, part, c1, c2, least, words) of crowded minimizers -> the stretches of them that two contents share: (key, c1, c2, shift, h1, h2, least, words).

    A minimizer's windows are its own, so windows of different groups meet only within it.
    """
    grouped = crowd.select("key", "part", "words").repartition("key", "part").sortWithinPartitions("key", "part")
    windows = materialise(grouped.mapInPandas(_windows, "key long, part int, w long, n long"))
    # Equal windows of one content count too: a window is left out only if it stands at one place.
    # Written, so that the join reads two plain shuffles and a common window's rows can be split.
    shared = materialise(windows.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").select("w"))
    marks = windows.join(shared, "w").groupBy("key", "part").agg(F.collect_list("w").alias("marks"))
    none = F.lit(0).cast("long")
    marks = marks.select("key", "part", none.alias("c1"), none.alias("c2"), none.alias("least"), F.lit(None).cast("binary").alias("words"), "marks")
    both = crowd.select("key", "part", "c1", "c2", "least", "words", F.lit(None).cast("array<long>").alias("marks")).union(marks)
    both = both.repartition("key", "part").sortWithinPartitions("key", "part", F.col("words").isNotNull())
    out = materialise(both.mapInPandas(_cut, "key long, c1 long, c2 long, shift int, h1 long, h2 long, least long, words binary"))
    discard(windows, shared)
    return out


def _judged(batches):
    for pdf in batches:
        rows = []
        for doc_id, text, starts, ends in zip(pdf["doc_id"], pdf["text"], pdf["starts"], pdf["ends"]):
            words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
            n, gone = len(words), 0
            if starts is not None and len(starts):
                drop = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
                kept = np.cumsum(drop[:n]) == 0
                gone = n - int(kept.sum())
                edge = np.flatnonzero(np.diff(kept, prepend=False, append=False)).tolist()
                words = [w for a, b in zip(edge[::2], edge[1::2]) for w in words[a:b]]
            rows.append((doc_id, n, gone, b" ".join(words).decode("utf-8", "replace")))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_text"])
        out["doc_id"] = pdf["doc_id"].array
        yield out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row of ``docs`` (doc_id, text); kept words are joined by one space."""
    bound_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    seg = "key long, c1 long, c2 long, doc_id long, th long, start int, windows int"
    every = materialise(d.filter("doc_id is not null").select("doc_id", "th", "text").mapInPandas(_segments, seg))
    shared = every.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key")
    found = materialise(every.join(shared, "key", "left_semi"))
    discard(every)
    content = found.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "th", "start", "windows", "key")).alias("at"))
    asked = content.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th")).agg(F.collect_list(F.struct(F.col("at.key").alias("key"), "c1", "c2", F.col("at.doc_id").alias("least"), F.col("at.start").alias("start"), F.col("at.windows").alias("windows"))).alias("wanted"))
    texts = d.join(asked, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    words = materialise(texts.select("text", "wanted").mapInPandas(_contents, "key long, c1 long, c2 long, least long, words binary"))
    sizes = words.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
    group = F.pmod(F.xxhash64("c1", "c2"), F.ceil(F.col("n") / GROUP)).cast("int").alias("part")
    crowded = materialise(words.join(sizes, "key").select("key", group, "c1", "c2", "least", "words"))
    simple = words.join(sizes.select("key"), "key", "left_anti")
    cut = thinned(crowded)
    again = cut.groupBy("key", "h1", "h2").agg(F.min("least").alias("least"), F.first("words").alias("words"))
    indexed = simple.union(again.select("key", F.col("h1").alias("c1"), F.col("h2").alias("c2"), "least", "words"))
    runs = indexed.repartition("key").sortWithinPartitions("key").mapInPandas(_shards, "c1 long, c2 long, first array<int>, end array<int>, least array<long>")
    runs = materialise(runs)
    parts = cut.select("h1", "h2", "c1", "c2", "shift").join(runs.withColumnsRenamed({"c1": "h1", "c2": "h2"}), ["h1", "h2"])
    moved = lambda c: F.transform(c, lambda x: x + F.col("shift"))
    # A crowded content's own documents share it whole.
    whole = crowded.select("c1", "c2", F.array(F.lit(0)), F.array((F.length("words") / 8).cast("int") - (WIDTH - 1)), F.array("least"))
    runs = runs.union(parts.select("c1", "c2", moved("first").alias("first"), moved("end").alias("end"), "least")).union(whole)
    discard(words)
    hits = found.join(runs, ["c1", "c2"]).filter(F.array_min("least") < F.col("doc_id"))
    # The words under the windows of each run that a smaller document holds.
    smaller = F.filter(F.arrays_zip("first", "end", "least"), lambda x: x["least"] < F.col("doc_id"))
    hits = hits.select("doc_id", "th", "start", smaller.alias("runs"))
    hits = hits.select("doc_id", "th", F.transform("runs", lambda x: F.col("start") + x["first"]).alias("starts"), F.transform("runs", lambda x: F.col("start") + x["end"] + (WIDTH - 1)).alias("ends"))
    hits = hits.groupBy("doc_id", "th").agg(F.collect_list(F.struct("starts", "ends")).alias("found"))
    hits = hits.select("doc_id", "th", F.flatten("found.starts").alias("starts"), F.flatten("found.ends").alias("ends"))
    out = d.join(hits, ["doc_id", "th"], "left").select("doc_id", "text", "starts", "ends")
    return out.mapInPandas(_judged, "doc_id long, n_words long, n_removed long, kept_text string")
