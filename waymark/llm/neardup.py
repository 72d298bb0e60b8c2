"""MinHash near-duplicate detection with fast similarity sketches.

Sketch: each of T coordinates is filled in rounds. In round i < T a hash
puts every shingle into one bin, where the least hash stays; bins filled
in an earlier round keep their value. In round T + b all shingles go into
bin b, so every coordinate is filled after 2T rounds for any non-empty
set, and agreement of coordinates is concentrated about the Jaccard
similarity as with T independent hashes.

Banding: T coordinates make ``bands`` bands of ``rows``; sets that agree
in a band share a bucket and are candidates. With 32 bands of 5 rows a
pair at similarity 0.8 shares none with probability 3e-6.

Texts of equal sets form one class, and classes are the nodes. In each
bucket every member is compared with the one of least node, the pivot;
all that share a bucket with a pivot p are its group. Groups that still
hold several components are looked at again, by differences from a centre:
let c be p's set, without the shingles that most of the group lack and
with those that most of it have beside p's. For a member x let ``dels``
be the shingles of c that x lacks and ``adds`` those that x has beyond c.
Two members that share no difference have ``|c| - |dels x| - |dels y|``
shingles in common and ``|c| + |adds x| + |adds y|`` in all, so they are
linked if and only if the sum of their costs ``100 |dels| + percent |adds|``
is at most ``(100 - percent) |c|``; shared differences only bring them
nearer. So those that meet this bound with the member of least cost, the
hub, are linked with it. The others, the strays, meet it with nobody, and
can be linked only with members with which they share a difference. So
only members that meet in a bucket (p, sign, shingle) of differences are
paired, and of these only pairs that are not yet connected, hold a stray,
and meet the size bound

    |c| - max(|dels x|, |dels y|) + (shared additions, where there are
    any) >= the intersection that sets of these sizes need.

A member enters only the buckets of its rarest differences, as far as what
comes after them could still make a link, and there only meets sizes that
could (``meeting_prefixes``). So pages of a section that share the
section's text but else have their own do not meet at it. They are confirmed from their differences, which give the intersection of
the full sets exactly. Copies with changes of their own share few
differences from what most of them have, so a large group of near copies
gives few pairs; what is paired is exact for all pairs that share a
bucket, and nothing is capped.

Rows are nodes by their text, not by their id: rows that share an id, or
have none, are handled each by its own text. Documents with no words have
the empty set, are linked with nothing and stand alone. A group without
any id has a null component. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import discard, free_name, small_batches, written
from waymark.llm.shingles import mix, shingle_sets, sliced_sets

BANDS, ROWS = 32, 5
#: Ratio of neighbouring bands of sizes among members that share a difference.
BAND_STEP = 1.1
#: Members that are dealt to one task together with a copy of their pivot's text.
MEMBERS_AT_ONCE = 500
#: Shingles sketched at a time, which bounds a worker's memory.
SHINGLES_AT_ONCE = 1 << 17
_GOLDEN = 0x9E3779B97F4A7C15


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketch of each set, a row of ``t`` values; rows of empty sets are arbitrary."""
    out = np.zeros((len(sets), t), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    at = 0
    while at < len(sets):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), SHINGLES_AT_ONCE, side="right")) + at)
        _fill(out[at:stop], sets[at:stop], sizes[at:stop])
        at = stop
    return out


def _fill(out: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray) -> None:
    n, t = out.shape
    filled = np.zeros((n, t), bool)
    filled[sizes == 0] = True
    for i in range(2 * t):
        todo = np.flatnonzero(~filled.all(axis=1) if i < t else ~filled[:, i - t])
        if not len(todo):
            if i < t or filled.all():
                break
            continue
        x = mix(np.concatenate([sets[d] for d in todo]) + np.uint64((i + 1) * _GOLDEN & (1 << 64) - 1))
        if i < t:
            # the high 32 bits choose the bin, all bits are the value
            bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
            cell = np.repeat(np.arange(len(todo)) * t, sizes[todo]) + bins
            least = np.full(len(todo) * t, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, cell, mix(x))
            hit = np.zeros(len(todo) * t, bool)
            hit[cell] = True
            least, new = least.reshape(-1, t), hit.reshape(-1, t) & ~filled[todo]
            out[todo] = np.where(new, least + np.uint64(i), out[todo])
            filled[todo] |= new
        else:
            first = np.concatenate(([0], np.cumsum(sizes[todo])[:-1]))
            out[todo, i - t] = np.minimum.reduceat(x, first) + np.uint64(i)
            filled[todo, i - t] = True


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band, different for each place of the band."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(_GOLDEN) + parts[:, :, r])
    return key.astype(np.int64)


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart."""
    return F.unhex(F.md5(text))


def signatures(slim: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, band_keys) of (doc_id, text_key, text) rows."""
    names = ["doc_id", "text_key", "n_shingles", "set_key", "band_keys"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in sliced_sets(batch.column(2), k):
                keys = band_keys(sketches(sets, bands * rows), bands, rows)
                offsets = pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32))
                part = batch.slice(at, len(sets))
                at += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    ],
                    names=names,
                )

    return slim.mapInArrow(signed, "doc_id long, text_key binary, n_shingles long, set_key binary, band_keys array<long>")


def differences(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(p, x, n_p, n_x, dels, adds) of each pair (p, x): the shingles that only p has, and those that only x has.

    ``texts`` has (node, text). A pivot's text goes once to each task that has up to about ``MEMBERS_AT_ONCE`` of its
    members, which follow it there one after another.
    """
    many = pairs.groupBy("p").agg(F.ceil(F.count("*") / F.lit(MEMBERS_AT_ONCE)).alias("parts"))
    dealt = pairs.join(many, "p").select("p", "x", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part"))
    of = texts.select(F.col("node").alias("x"), "text")
    heads = many.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rows = (
        heads.join(texts.select(F.col("node").alias("p"), "text"), "p").select("p", "part", F.lit(None).cast("long").alias("x"), "text")
        .unionByName(dealt.join(of, "x").select("p", "part", "x", "text"))
    )
    names = ["p", "x", "n_p", "n_x", "dels", "adds"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ps, xs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at = 0
            for sets in sliced_sets(batch.column(3), k):
                out = []
                for p, x, s in zip(ps[at : at + len(sets)], xs[at : at + len(sets)], sets, strict=True):
                    if x is None:
                        pivot, base = p, s
                    elif p == pivot:
                        out.append((p, x, len(base), len(s), np.setdiff1d(base, s, True), np.setdiff1d(s, base, True)))
                    else:
                        raise ValueError(f"the text of pivot {p} did not come before its members")
                at += len(sets)
                if out:
                    columns = list(zip(*out, strict=True))
                    lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, c)]).astype(np.int32), pa.array(np.concatenate(c).astype(np.int64))) for c in columns[4:]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), *lists], names=names)

    dealt = rows.repartition("p", "part").sortWithinPartitions("p", "part", F.col("x").asc_nulls_first())
    return dealt.mapInArrow(compared, "p long, x long, n_p long, n_x long, dels array<long>, adds array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable over the undirected ``edges`` (a, b).

    Alternates large-star and small-star steps, each a join and an aggregate over the edges, until the edges no
    longer change; each round is written, so that lineage stays short.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = e.join(least, "a")
        if large:  # each larger neighbour is tied to the least one
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # edges point to smaller ids here: all of them, and the node itself, are tied to the least
        near = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return near.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "stars")
    before = state(now)
    while before[0]:
        nxt = written(star(star(now, True), False), "stars")
        after = state(nxt)
        discard(now)
        now = nxt
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _linked(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets of these sizes reach the similarity with so many (or at most so many) shingles in common."""
    return (common > 0) & (common * (100 + percent) >= (n_a + n_b) * percent)


def _joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The components ``found`` after ``edges`` are added."""
    if edges.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(edges))


def _labels(df: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``df`` with the component of its node ``name``, which is the node itself where ``found`` lacks it."""
    comp = f"{name}_comp"
    named = found.select(F.col("node").alias(name), F.col("component").alias(comp))
    return df.join(named, name, "left").withColumn(comp, F.coalesce(comp, name))


def centred(compared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The members of groups that hold several components, with their differences from the group's centre.

    ``compared`` has the ``differences`` of members from their pivots; gives (p, x, x_comp, n_x, n_c, d, a, dels, adds,
    stray, hub, hub_comp), the hub being the member of least cost.
    """
    none = F.array().cast("array<long>")
    pivots = compared.select("p", F.col("p").alias("x"), "n_p", F.col("n_p").alias("n_x"), none.alias("dels"), none.alias("adds")).distinct()
    members = _labels(compared.unionByName(pivots), found, "x")
    groups = members.groupBy("p").agg(F.count("*").alias("n_members"), F.min("x_comp").alias("low"), F.max("x_comp").alias("high"))
    groups = groups.where("low < high AND n_members > 2").select("p", "n_members")
    members = written(members.join(groups, "p"), "members")
    each = members.select("p", "n_members", F.lit(False).alias("added"), F.explode("dels").alias("shingle")).unionByName(
        members.select("p", "n_members", F.lit(True).alias("added"), F.explode("adds").alias("shingle"))
    )
    most = each.groupBy("p", "n_members", "added", "shingle").agg(F.count("*").alias("n")).where("2 * n > n_members")
    most = most.groupBy("p").agg(F.collect_list(F.when(~F.col("added"), F.col("shingle"))).alias("most_lack"), F.collect_list(F.when(F.col("added"), F.col("shingle"))).alias("most_have"))
    d = members.join(most, "p", "left").withColumns({c: F.coalesce(c, none) for c in ("most_lack", "most_have")})
    beyond = lambda own, most, other, lost: F.concat(F.array_except(own, most), F.array_except(lost, other))
    d = d.select(
        "p", "x", "x_comp", "n_x", (F.col("n_p") - F.size("most_lack") + F.size("most_have")).alias("n_c"),
        beyond("dels", "most_lack", "adds", "most_have").alias("dels"), beyond("adds", "most_have", "dels", "most_lack").alias("adds"),
    )
    d = d.withColumn("d", F.size("dels").cast("long")).withColumn("a", F.size("adds").cast("long")).withColumn("cost", 100 * F.col("d") + percent * F.col("a"))
    d = written(d, "centred")
    discard(members)
    hubs = d.groupBy("p").agg(F.min(F.struct("cost", F.col("x").alias("hub"), F.col("x_comp").alias("hub_comp"))).alias("h")).select("p", "h.*")
    hubs = hubs.withColumnRenamed("cost", "hub_cost")
    out = written(d.join(hubs, "p").withColumn("stray", F.col("cost") + F.col("hub_cost") > (100 - percent) * F.col("n_c")).drop("cost", "hub_cost"), "centred")
    discard(d)
    return out


def meeting_prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """The rows of ``tokens`` (p, x, n_c, n_x, d, stray, x_comp, added, shingle) at which a pair can meet first.

    Of each member additions come before deletions, in either the differences that it can share with nobody first and then the
    rarest. If a pair's first shared difference is the i-th of x, then x has only those from there on to share, ``avail``
    of them, and the pair has at most ``n_c - d_x - d_y + avail`` shingles in common. So it is linked only if
    ``u_y = percent n_y + (100 + percent) d_y`` is at most ``cap_x``, and the other way round. Rows whose ``cap`` is under
    what the smallest possible partner has are left out.
    """
    at = ["p", "added", "shingle"]
    meeting = tokens.groupBy(*at).agg(F.min("x_comp").alias("low"), F.max("x_comp").alias("high"), F.max("stray").alias("any"), F.count("*").alias("n_has"))
    meet = tokens.join(meeting.where("low < high and any").select(*at, "n_has"), at)
    own = W.partitionBy("p", "x", "added")  # one member's differences
    m, nth = F.count("*").over(own), F.row_number().over(own.orderBy("n_has", "shingle"))
    meet = meet.withColumn("n_added", F.when(F.col("added"), m).otherwise(0)).withColumn("avail", m - nth + 1 + F.when(F.col("added"), F.col("d")).otherwise(0))
    full = 100 + percent
    meet = meet.withColumn("u", percent * F.col("n_x") + full * F.col("d")).withColumn("cap", full * (F.col("n_c") - F.col("d") + F.col("avail")) - percent * F.col("n_x"))
    meet = meet.withColumn("floor", F.floor(percent * percent * F.col("n_x") / 100))
    return meet.where("cap >= floor").drop("n_has", "avail")


def met_pairs(meet: DataFrame, percent: int) -> DataFrame:
    """(p, x, y), with repeats: pairs with a stray that share a difference at which their sizes still allow a link.

    A bucket is a difference and a band of ``u`` (a step of ``BAND_STEP``). A stray goes to the bands that its ``cap`` allows, the
    others wait in their own, so that members too different in all the rest do not meet, however many share a difference.
    """
    at = ["p", "added", "shingle", "band"]
    band = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(0)) + 1) / float(np.log(BAND_STEP)))
    left = meet.where("stray").withColumn("band", F.explode(F.sequence(band("floor"), band("cap"))))
    right = meet.withColumn("band", band("u")).select(*at, *(F.col(c).alias(f"y_{c}") for c in ("x", "n_x", "d", "stray", "x_comp", "n_added", "u", "cap")))
    bound = F.col("n_c") - F.greatest("d", "y_d") + F.least("n_added", "y_n_added")
    allowed = (F.col("y_u") <= F.col("cap")) & (F.col("u") <= F.col("y_cap")) & (F.col("x_comp") != F.col("y_x_comp")) & (~F.col("y_stray") | (F.col("x") < F.col("y_x")))
    return left.join(right, at).where(allowed & _linked(bound, F.col("n_x"), F.col("y_n_x"), percent)).select("p", "x", F.col("y_x").alias("y"))


def further_links(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of strays that ``found`` has not connected; ``members`` is what ``centred`` gives."""
    members = _labels(members.drop("x_comp", "hub", "hub_comp"), found, "x")
    # the largest set that may be linked with x if no addition is shared
    room = F.floor((F.col("n_c") - F.col("d")) * (100 + percent) / percent) - F.col("n_x")
    groups = members.groupBy("p").agg(
        F.min("x_comp").alias("low"), F.max("x_comp").alias("high"), F.min("n_x").alias("least"), F.max(F.when(F.col("stray"), room)).alias("most_room")
    )
    groups = groups.where("low < high AND most_room IS NOT NULL").drop("low", "high")
    members = written(members.join(groups, "p"), "members")
    near = F.greatest(F.col("least"), F.ceil(F.col("n_x") * percent / 100))
    may_share_dels = (F.col("n_x") <= F.col("most_room")) | (F.col("stray") & (room >= near))
    facts = ["p", "x", "n_c", "n_x", "d", "stray", "x_comp"]
    tokens = written(
        members.select(*facts, F.lit(True).alias("added"), F.explode("adds").alias("shingle"))
        .unionByName(members.where(may_share_dels).select(*facts, F.lit(False).alias("added"), F.explode("dels").alias("shingle"))),
        "differences",
    )
    meet = written(meeting_prefixes(tokens, percent), "meeting")
    discard(tokens)
    candidates = met_pairs(meet, percent).select("p", "x", "y").distinct()
    candidates = written(candidates, "candidates")
    discard(meet)
    slim = members.select("p", "x", "n_c", "n_x", "d", "dels", "adds")
    other = slim.select("p", *(F.col(c).alias(f"y_{c}") for c in ("n_x", "d", "dels", "adds")), F.col("x").alias("y"))
    common = F.col("n_c") - F.col("d") - F.col("y_d") + F.size(F.array_intersect("dels", "y_dels")) + F.size(F.array_intersect("adds", "y_adds"))
    links = candidates.join(slim, ["p", "x"]).join(other, ["p", "y"]).where(_linked(common, F.col("n_x"), F.col("y_n_x"), percent))
    out = written(links.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    discard(members)
    discard(candidates)
    return out


def classified(df: DataFrame, key: str, text: str, k: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (doc_id, text_key, n_shingles, set_key) of each row, and of each different non-empty set
    (set_key, rep, rep_key, component_id): the id and text that stand for it, and its component's least id."""
    small_batches(df.sparkSession)
    slim = df.select(F.col(key).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    full = written(signatures(slim, k, bands, rows), "signatures")
    # the class is stood for by its row of least id; rows without an id come last
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    banded = full.where("n_shingles > 0").groupBy("set_key").agg(F.min(first).alias("first"), F.first("band_keys").alias("band_keys"))
    banded = written(
        banded.select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key"), "band_keys", F.monotonically_increasing_id().alias("node")), "classes"
    )
    signs = written(full.drop("band_keys"), "signatures")
    discard(full)
    exploded = banded.select("node", F.explode("band_keys").alias("bucket"))
    buckets = exploded.groupBy("bucket").agg(F.min("node").alias("p"), F.max("node").alias("top")).where("p < top").select("bucket", "p")
    pairs = written(exploded.join(buckets, "bucket").where(F.col("node") != F.col("p")).select("p", F.col("node").alias("x")).distinct(), "pairs")
    classes = written(banded.drop("band_keys"), "classes")
    discard(banded)
    nodes = pairs.select(F.col("p").alias("node")).unionByName(pairs.select(F.col("x").alias("node"))).distinct()
    wanted = classes.select("node", F.col("rep").alias("doc_id"), F.col("rep_key").alias("text_key")).join(nodes, "node")
    same_row = slim["doc_id"].eqNullSafe(wanted["doc_id"]) & (slim["text_key"] == wanted["text_key"])
    # what is wanted grows with the corpus, so it is never broadcast
    texts = written(slim.join(wanted.hint("merge"), same_row).groupBy("node").agg(F.first("text").alias("text")), "texts")
    compared = written(differences(pairs, texts, k), "compared")
    discard(texts)
    discard(pairs)
    close = _linked(F.col("n_p") - F.size("dels"), F.col("n_p"), F.col("n_x"), percent)
    found = components(compared.where(close).select(F.col("p").alias("a"), F.col("x").alias("b")))
    members = centred(compared, found, percent)
    discard(compared)
    near_hub = members.where("NOT stray AND x_comp <> hub_comp").select(F.col("hub").alias("a"), F.col("x").alias("b"))
    found = _joined(found, near_hub)
    found = _joined(found, further_links(members, found, percent))
    discard(members)

    # the least id of each component of several classes
    labelled = classes.select("set_key", "rep", "rep_key", "node")
    both = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    joined = both.join(labelled.select("node", "rep"), "node")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = both.join(least, "component").select("node", "component", "component_id")
    labelled = labelled.join(named, "node", "left").select(
        "set_key", "rep", "rep_key", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id")
    )
    labels = written(labelled, "labels")
    discard(classes)
    return signs, labels


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; documents are linked at ``percent`` or more of Jaccard similarity.

    ``kept`` tells rows whose id is their component's, rows without words, and rows of groups without any id.
    """
    signs, labels = classified(df, key, text, k, percent, bands, rows)
    some = signs.where("n_shingles > 0").join(labels.select("set_key", "component_id"), "set_key").select("doc_id", "n_shingles", "component_id")
    out = some.unionByName(signs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """The rows of ``df``, with all their columns, without those that a row of their group stands for.

    Of each group one row stays: that of least id (rows without an id come last), and of rows that share id and text the
    one of least hash over all columns. Rows without words stay.
    """
    key_col, best_col, comp_col, row_col = (free_name(df, c) for c in ("text_key", "best", "component", "row"))
    signs, labels = classified(df, key, text, k, percent, bands, rows)
    sizes = signs.where("n_shingles > 0").groupBy("set_key", "text_key").agg(F.count("*").alias("n_rows"))
    found = sizes.join(labels, "set_key")
    # texts whose rows are in question: those of components that have several rows
    several = found.groupBy("component").agg(F.sum("n_rows").alias("n_rows"), F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("rep_key"))).alias("best")).where("n_rows > 1")
    best = F.coalesce(F.col("best.rep_key") == F.col("text_key"), F.lit(False))
    asked = written(found.select("text_key", "component").join(several.select("component", "best"), "component").select("text_key", best.alias("best"), "component"), "asked")
    asked = asked.groupBy(F.col("text_key").alias(key_col)).agg(F.max("best").alias(best_col), F.min("component").alias(comp_col))
    marked = df.join(asked.hint("merge"), text_key(F.col(text)) == F.col(key_col), "left")
    alone = marked.where(F.col(key_col).isNull()).select(*df.columns)
    order = F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), F.xxhash64(*df.columns).alias("hash"))
    least = marked.where(best_col).groupBy(comp_col).agg(F.min_by(F.struct(*df.columns), order).alias(row_col))
    return alone.unionByName(least.select(f"{row_col}.*"))
