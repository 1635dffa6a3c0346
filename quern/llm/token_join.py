"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its hashed word shingles, in the order of their hashes. Two sets whose Jaccard similarity is
0.75 or more share, for every l, at least l tokens of their extended prefixes: the first n - ceil(0.75 n) + l tokens of
n. Here l is a sixteenth of n, one at least. Token classes follow from counts:

- A token that one set alone has can't be shared. A set that has too many such tokens in its extended prefix, and, when
  its whole text is read again, too few shared tokens altogether, has no partner and leaves.
- Rare tokens of extended prefixes are indexed one by one.
- Frequent tokens are indexed in combinations of two. Tokens fall into fewer groups by hash than must be shared, so two
  shared ones meet in a group (pigeonhole), and only pairs within a group are combined: their number is linear in n.

A pair that shares no rare token of its prefixes shares as many frequent ones as the prefix theorem says, hence a
combination: no link is lost. Buckets are first linked through leaders, the sets with the largest shared part: each set
is compared with the LEADERS leaders it meets most often. Pairs in one component need no check any more. A pair between
components is open if it can reach the similarity by size, by shared part, and by what both share with a leader (of a
leader's tokens two sets share at most what the lesser has); all open pairs are verified, first by bitmaps of parities,
which only rule out, then exactly. No group is paired with itself,
and exact copies are one set throughout.

Defined results: null and wordless texts have no shingles, n_shingles 0, and are linked with nothing (component_id is
their own id). Repeated rows are copies. A null id takes part, and its component's id is the smallest that is not null.
An empty table gives no rows. Other columns are ignored. Hashes have 64 bits; sets that differ are taken for equal with
a probability of about 2 ** -64 a pair.

Steps are written often, so that no plan is large: the driver describes, adapts and logs the whole plan whenever a stage
of it ends, and its memory follows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.graph import connected_components
from quern.llm.shingles import mixed, portions, set_key, shingle_sets
from quern.session import discard, staged

#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: The extended prefix has n / EXTENSION more tokens.
EXTENSION = 16
#: A token in more sets is of the frequent class, whatever the corpus: no rare token's bucket holds more.
FREQUENT = 64
#: Followers of a leader that meet in one task; beyond it, they are dealt by hash.
FOLLOWERS = 65_536
#: Rows of eight bytes that are broadcast at most.
MOST_BROADCAST = 2_000_000
#: Leaders that each set is compared with before open pairs are looked for.
LEADERS = 3
#: Smallest signatures of a set that are carried along, so that most pairs come up in one bucket only.
LOWEST = 8


def required(n: int) -> int:
    """Tokens that a set of n shares with any partner, at least; also a partner's least size."""
    return -(-PERCENT * n // 100)


def extension(n: int) -> int:
    return max(1, n // EXTENSION)


def extended_prefix(n: int) -> int:
    return min(n, n - required(n) + extension(n))


def _required(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100)


def _extension(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / EXTENSION))


def _extended_prefix(n: Column) -> Column:
    return F.least(n, n - _required(n) + _extension(n))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in portions(batch, "_text"):
            found = shingle_sets(data, offsets)
            keys = pa.array([set_key(s) if len(s) else None for s in found], pa.int64())
            sizes = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("_copy"), part.column("_row"), keys, sizes], names=["doc_id", "_copy", "_row", "rid", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in portions(batch, "_text"):
            seen = {set_key(s): s[: extended_prefix(len(s))] for s in shingle_sets(data, offsets) if len(s)}
            lengths = np.fromiter(map(len, seen.values()), np.int64, len(seen))
            tokens = np.concatenate([*seen.values(), np.zeros(0, np.uint64)]) >> np.uint64(1)
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lengths.cumsum()]), pa.int32()), pa.array(tokens.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), arrays], names=["rid", "tokens"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in portions(batch, "_text"):
            seen = {set_key(s): s for s in shingle_sets(data, offsets) if len(s)}
            lengths = np.fromiter(map(len, seen.values()), np.int64, len(seen))
            tokens = np.concatenate([*seen.values(), np.zeros(0, np.uint64)]) >> np.uint64(1)
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lengths.cumsum()]), pa.int32()), pa.array(tokens.astype(np.int64)))
            bits = pa.array([parity(s >> np.uint64(1)) for s in seen.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(lengths), arrays, bits], names=["rid", "n", "tokens", "bits"])


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of a set, as 64-bit numbers: bit i tells whether an odd number of its tokens has i as low bits. It has
    a bit a token, or up to two; each token in which two sets differ changes one bit of what theirs differ in."""
    size = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def group_counts(n: int) -> list[int]:
    """Numbers of groups that a pair with a set of n may use, 0 for none (single tokens)."""
    most, least = extension(n), extension(required(n))
    out = [] if least > 1 else [0]
    groups = 1 << (most - 1).bit_length() - 1 if most > 1 else 0
    floor = 1 << (least - 1).bit_length() - 1 if least > 1 else 1
    while groups >= floor:
        out.append(groups)
        groups //= 2
    return out


def signatures(n: int, tokens: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """What a set of n indexes for the shared tokens of its extended prefix, each in `counts` sets, rare up to `most`."""
    out = [tokens[counts <= most]]
    frequent = np.sort(tokens[counts > most]).astype(np.uint64)
    places = mixed(frequent)
    for groups in group_counts(n) if len(frequent) else ():
        if not groups:
            out.append(frequent.astype(np.int64))
            continue
        members = defaultdict(list)
        for place, token in zip((places % np.uint64(groups)).tolist(), frequent.tolist()):
            members[place].append(token)
        pairs = np.array([p for own in members.values() for p in combinations(own, 2)], np.uint64).reshape(-1, 2)
        out.append(mixed(mixed(pairs[:, 0]) * np.uint64(31) + pairs[:, 1] + np.uint64(groups)).astype(np.int64))
    return np.concatenate(out)


def _signing(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column("shared")
            ends, inner = shared.offsets.to_numpy(), shared.values
            tokens, counts = inner.field("token").to_numpy(), inner.field("count").to_numpy()
            found = [signatures(n, tokens[a:b], counts[a:b], most) for n, a, b in zip(batch.column("n").to_pylist(), ends, ends[1:])]
            lengths = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            arrays = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]), pa.int64()))
            names = [name for name in batch.schema.names if name != "shared"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), arrays], names=[*names, "signatures"])

    return run


def _halved(bits: Column, other: Column) -> Column:
    """The bitmap at half its size where the other has fewer bits; sizes of compatible sets differ by a factor 2 at most."""
    half = (F.size(bits) / 2).cast("int")
    folded = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > F.size(other), folded).otherwise(bits)


def near_by_parity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not rule out that they are similar enough: similar sets differ in no more than
    a seventh of their tokens (for 75 %), and bitmaps differ in no more bits than sets in tokens. No link is lost."""
    left = sets.select(F.col("rid").alias("a"), F.col("n").alias("_an"), F.col("bits").alias("_ab"))
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("_bn"), F.col("bits").alias("_bb"))
    x, y = _halved(F.col("_ab"), F.col("_bb")), _halved(F.col("_bb"), F.col("_ab"))
    apart = F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, one: total + one)
    total = F.col("_an") + F.col("_bn")
    return pairs.join(left, "a").join(right, "b").filter(apart * (100 + PERCENT) <= total * (100 - PERCENT)).select("a", "b")


def lone_tokens(rows: DataFrame) -> DataFrame:
    """(rid, lone): how many of the tokens in rows (rid, token) no other rid has. Sums combine before the shuffle."""
    owners = rows.groupBy("token").agg(F.min("rid").alias("rid"), F.max("rid").alias("_other"))
    return owners.filter("rid = _other").groupBy("rid").agg(F.count("*").alias("lone"))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rids with the number of tokens that they share, and whether that makes them similar enough."""
    left = sets.select(F.col("rid").alias("a"), F.col("tokens").alias("_a"))
    right = sets.select(F.col("rid").alias("b"), F.col("tokens").alias("_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("_a", "_b")))
    similar = 100 * F.col("shared") >= PERCENT * (F.size("_a") + F.size("_b") - F.col("shared"))
    return both.select("a", "b", "shared", similar.alias("linked"))


def _compatible(x: str, y: str) -> Column:
    """By size and shared part, x and y can be similar enough."""
    need = (F.col(f"{x}.n") + F.col(f"{y}.n")) * PERCENT
    return (F.least(f"{x}.most", f"{y}.most") * (100 + PERCENT) >= need) & (F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * PERCENT)


def _reaches(shared: Column, total: Column) -> Column:
    """So many shared tokens, of two sets with so many together, make them similar enough."""
    return shared * (100 + PERCENT) >= total * PERCENT


def _led_pairs(able: DataFrame, about: DataFrame, whole: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Open pairs (a, b) of sets that were compared with the same leader, and the staged tables that they are read from.

    Inside the leader, two sets share no more than the lesser of what each shares with it. If that is too few for the
    pair, it must share a token outside the leader, and is found by such tokens, which are few; else by its leader."""
    parts = about.select(F.col("rid").alias("first"), F.col("part").alias("_leader_part"))
    met = about.filter("via IS NOT NULL").select("rid", "part", F.explode("via").alias("first", "shared"))
    led = able.join(met, "rid").join(parts, "first").select("rid", "n", "most", "part", "first", "shared", (F.col("part") != F.col("_leader_part")).alias("open"))
    rest = F.col("most") - F.col("shared")
    reach = led.groupBy("first").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("salts"), F.min("n").alias("least"), F.max("shared").alias("_s"), F.max(rest).alias("_r"), F.max(F.when(F.col("open"), F.col("shared"))).alias("_os"), F.max(F.when(F.col("open"), rest)).alias("_or"))
    partner = F.col("n") + F.greatest("least", _required(F.col("n")))
    some = F.when(F.col("open"), F.least("shared", "_s") + F.least(rest, F.col("_r"))).otherwise(F.least("shared", "_os") + F.least(rest, F.col("_or")))
    led = led.join(reach.filter("_os IS NOT NULL"), "first").filter(_reaches(some, partner))
    led = staged(led.select("first", F.struct("rid", "n", "most").alias("set"), "part", "shared", "open", "salts"))
    salt = F.pmod(F.xxhash64("set.rid"), F.col("salts")).cast("int")  # x is dealt by it, y goes to all
    x = lambda rows: rows.filter("open").select("first", salt.alias("xd"), *(c for c in rows.columns if c == "token"), F.col("set").alias("x"), F.col("part").alias("xp"), F.col("shared").alias("xs"))
    y = lambda rows: rows.select(F.col("first").alias("_f"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("yd"), *(F.col(c).alias("_t") for c in rows.columns if c == "token"), F.col("set").alias("y"), F.col("part").alias("yp"), F.col("shared").alias("ys"), F.col("open").alias("yo"))
    once = ~F.col("yo") | (F.col("x.rid") < F.col("y.rid"))
    fit = (F.col("xp") != F.col("yp")) & once & _compatible("x", "y")
    total, inner = F.col("x.n") + F.col("y.n"), F.least("xs", "ys")
    ends = lambda rows: rows.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b"))
    dealt = (F.col("first") == F.col("_f")) & (F.col("xd") == F.col("yd"))
    by_leader = staged(ends(x(led).join(y(led), dealt & fit & _reaches(inner, total))))
    own, leaders = whole.select("rid", "tokens"), whole.select(F.col("rid").alias("first"), F.col("tokens").alias("_l"))
    outside = led.join(own, F.col("set.rid") == F.col("rid")).join(leaders, "first").select("first", "set", "part", "shared", "open", F.explode(F.array_except("tokens", "_l")).alias("token"))
    outside = own_outside = staged(outside)
    several = outside.groupBy("first", "token").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("salts"), F.min("part").alias("_x"), F.max("part").alias("_y")).filter("_x < _y").select("first", "token", "salts")
    outside = outside.join(several, ["first", "token"])
    bound = inner + F.least(F.col("x.most") - F.col("xs"), F.col("y.most") - F.col("ys"))
    by_token = staged(ends(x(outside).join(y(outside), dealt & (F.col("token") == F.col("_t")) & fit & ~_reaches(inner, total) & _reaches(bound, total))))
    discard(led, own_outside)
    return by_leader.union(by_token), [by_leader, by_token]


def _survivors(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(rid, n, tokens) of the sets that may have a partner. texts: _row, _text. sets: rid, n, rep."""
    prefixes = texts.select("_text").mapInArrow(_prefixes, "rid long, tokens array<long>")
    lone = lone_tokens(prefixes.select("rid", F.explode("tokens").alias("token")))
    shared = _extended_prefix(F.col("n")) - F.coalesce("lone", F.lit(0))
    likely = staged(sets.join(lone, "rid", "left").filter(shared >= _extension(_required(F.col("n")))).select(F.col("rep.row").alias("_row")))
    # few enough rows of one number each go to all executors; else texts are exchanged by _row, as for dropDuplicates
    few = F.broadcast(likely) if likely.count() <= MOST_BROADCAST else likely.hint("merge")
    again = texts.join(few, "_row", "left_semi").dropDuplicates(["_row"])
    found = staged(again.select("_text").mapInArrow(_whole, "rid long, n long, tokens array<long>, bits array<long>"))
    discard(likely)
    return found


def links(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) of rids that connect every two sets that similar pairs connect."""
    survivors = whole = _survivors(texts, sets)
    rows = whole.select("rid", F.explode("tokens").alias("token"))
    most = F.col("n") - F.coalesce("lone", F.lit(0))
    able = whole.select("rid", "n").join(lone_tokens(rows), "rid", "left").select("rid", "n", most.alias("most")).filter(F.col("most") >= _required(F.col("n")))
    whole = staged(whole.join(able.select("rid", "most"), "rid"))
    discard(survivors)
    able = whole.select("rid", "n", "most")
    heads = whole.select("rid", "n", "most", F.explode(F.slice("tokens", F.lit(1), _extended_prefix(F.col("n")).cast("int"))).alias("token"))
    heads = staged(heads)
    counts = heads.groupBy("token").agg(F.count("*").alias("count")).filter("count > 1")
    shared = heads.join(counts, "token").groupBy("rid", "n", "most").agg(F.collect_list(F.struct("token", "count")).alias("shared"))
    signed = staged(shared.mapInArrow(_signing(FREQUENT), "rid long, n long, most long, signatures array<long>"))
    discard(heads)
    index = signed.select(F.explode("signatures").alias("signature"), F.struct("rid", "n", "most").alias("set"))
    lowest = signed.select("rid", F.slice(F.sort_array("signatures"), 1, LOWEST).alias("low"))
    leaders = index.groupBy("signature").agg(F.max_by("set", F.struct(F.col("set.most") / F.col("set.n"), "set.rid")).alias("leader"), F.count("*").alias("_n")).filter("_n > 1")
    met = index.join(leaders, "signature").filter((F.col("set.rid") != F.col("leader.rid")) & _compatible("set", "leader"))
    votes = met.groupBy(F.col("set.rid").alias("rid"), F.col("leader.rid").alias("leader")).agg(F.count("*").alias("votes"), F.first("set.n").alias("n"))
    order = Window.partitionBy("rid").orderBy(F.desc("votes"), "leader")
    best = staged(votes.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= LEADERS).select("rid", "n", "leader"))
    tried = staged(compared(best.select(F.least("rid", "leader").alias("a"), F.greatest("rid", "leader").alias("b")).distinct(), whole))
    edges = tried.filter("linked").select("a", "b")
    labels = connected_components(edges).withColumnsRenamed({"v": "rid", "label": "part"})
    known = best.select("rid", "n", F.col("leader").alias("via")).join(tried, (F.least("rid", "via") == F.col("a")) & (F.greatest("rid", "via") == F.col("b")))
    known = known.filter(2 * F.col("shared") >= F.col("n")).select("rid", "via", "shared").union(best.select("leader", "leader").distinct().join(able, F.col("leader") == F.col("rid")).select("rid", "rid", F.col("n").cast("int")))
    via = staged(known.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("via", "shared"))).alias("via")))  # at most LEADERS + 1
    about = able.select("rid").join(labels, "rid", "left").join(via, "rid", "left").join(lowest, "rid", "left")
    about = staged(about.select("rid", F.coalesce("part", "rid").alias("part"), "via", F.map_keys("via").alias("met"), "low"))
    discard(best, via)
    placed = staged(index.join(about.select("rid", "part"), F.col("set.rid") == F.col("rid")).select("signature", "set", "part"))
    split = placed.groupBy("signature").agg(
        F.min("part").alias("_x"), F.max("part").alias("_y"), F.mode("part").alias("main"), F.min("set.n").alias("least")
    ).filter("_x < _y").drop("_x", "_y")
    open_sets = placed.join(split, "signature").filter(_reaches(F.col("set.most"), F.col("set.n") + F.greatest("least", _required(F.col("set.n")))))
    open_sets = staged(open_sets.drop("least"))
    discard(placed)
    known = about.select("rid", "met", "low")
    x = open_sets.filter("part != main").join(known, F.col("set.rid") == F.col("rid"))
    asked = x.select("signature").distinct()
    x = x.select("signature", F.col("set").alias("x"), F.col("part").alias("xp"), F.col("met").alias("xm"), F.col("low").alias("xl"), F.col("main").alias("_m"))
    y = open_sets.join(asked, "signature", "left_semi").join(known, F.col("set.rid") == F.col("rid"))
    y = y.select("signature", F.col("set").alias("y"), F.col("part").alias("yp"), F.col("met").alias("ym"), F.col("low").alias("yl"))
    once = (F.col("yp") == F.col("_m")) | (F.col("x.rid") < F.col("y.rid"))
    apart = ~F.coalesce(F.arrays_overlap("xm", "ym"), F.lit(False))
    before = F.exists(F.array_intersect("xl", "yl"), lambda low: low < x["signature"])  # the pair comes up there
    across = x.join(y, (x["signature"] == y["signature"]) & (F.col("xp") != F.col("yp")) & once & _compatible("x", "y") & apart & ~before)
    across = staged(across.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")))
    discard(open_sets)
    led, behind = _led_pairs(able, about, whole)
    pairs = staged(across.union(led).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    discard(across, *behind)
    near = staged(near_by_parity(pairs, whole))
    found = staged(edges.union(compared(near, whole).filter("linked").select("a", "b")))
    discard(pairs, near, about, tried, signed, whole)
    return found


def jaccard_components(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id; with keep also _row, a hash of id and text, and first: whether the
    row's (id, text) is the least of its component."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(whole).alias("_copy"), F.xxhash64("doc_id", whole).alias("_row"), whole.alias("_text"))
    own = staged(texts.mapInArrow(_sets, "doc_id long, _copy long, _row long, rid long, n long"))
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_copy").alias("copy"), F.col("_row").alias("row"))
    sets = own.filter("rid IS NOT NULL").groupBy("rid").agg(F.first("n").alias("n"), F.min(rep).alias("rep"))
    sets = staged(sets)
    labels = connected_components(links(texts.select("_row", "_text"), sets)).withColumnsRenamed({"v": "rid", "label": "part"})
    placed = staged(sets.join(labels, "rid", "left").select("rid", "rep", F.coalesce("part", "rid").alias("part")))
    firsts = placed.groupBy("part").agg(F.min("rep").alias("first"))
    placed = placed.join(firsts, "part").select(F.col("rid").alias("_rid"), "first")
    rows = own.join(placed, F.col("rid") == F.col("_rid"), "left")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_rid").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "_row", (F.col("_rid").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_copy") == F.col("first.copy")))).alias("first"))
    return out if keep else out.drop("_row", "first")
