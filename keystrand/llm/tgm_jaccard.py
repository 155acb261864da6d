"""N-gram Jaccard join with a token-group matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, shuffle_width, sliced
from .shingles import set_digest, shingle_set

#: Cells of the frequency sketch that orders tokens; one byte each, at every size of the corpus.
CELLS = 1 << 23
#: Cells of the sketch that reach the driver as one row of bytes.
STRIPE = 1 << 15
#: Tokens that a map task packs at a time, and that it counts at a time.
CHUNK_TOKENS, COUNT_TOKENS = 1_500_000, 2_000_000
#: A set of ids up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_IDS = 200_000
#: Tokens of one block of an opened group, and of the classes that it is opened for.
BLOCK_TOKENS = 1 << 20
#: Bit of a group's number that is set where its members are one component; the band lies below it.
TIED = 128

#: A class in one part: how many of the part's tokens are its own; its other columns are of the whole set.
_OWNER = np.dtype([("cls", "<i8"), ("n", "<u4"), ("alone", "<u2"), ("held", "<u4")])


def prefix_length(n, num: int, den: int):
    """Tokens of a set of ``n`` of which a partner at threshold ``num / den`` shares at least one."""
    return n - -(-num * n // den) + 1


def need_overlap(nx, ny, num: int, den: int):
    """Least intersection of two sets at the threshold."""
    return -(-num * (nx + ny) // (num + den))


def _narrow_pass(batches):
    """Per document: id, set size, digest.  Per chunk: cells of the tokens that several of its documents hold."""
    held: list[np.ndarray] = []
    size = 0

    def frequent():
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        same = np.concatenate([[False], tokens[1:] == tokens[:-1], [False]])
        tokens = tokens[same[1:] | same[:-1]]  # those that another document of the chunk holds too
        t, c = np.unique(_cell(tokens), return_counts=True)
        none = pa.nulls(len(t), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(t), pa.binary()), none, pa.array(t), pa.array(c.astype(np.int64))], names=["id", "n", "sig", "cls", "cell", "cnt"])

    for b in batches:
        n, sig = [], []
        for text in b.column(1):
            s = shingle_set(text.as_py())
            n.append(len(s))
            sig.append(set_digest(s) if len(s) else None)
            held.append(s)
            size += len(s)
            if size >= COUNT_TOKENS:
                yield frequent()
                held, size = [], 0
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array([_class_of(x) if x else None for x in sig], pa.int64()), none, none], names=["id", "n", "sig", "cls", "cell", "cnt"])
    if held:
        yield frequent()


def _cell(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(7)) % np.uint64(CELLS)).astype(np.int64)


def _stripe(table: pa.Table) -> pa.Table:
    """The cells of one stripe of the sketch as bytes."""
    cell = table.column("cell").to_numpy()
    level = np.zeros(STRIPE, np.uint8)
    level[cell % STRIPE] = table.column("level").to_numpy()
    return pa.table({"stripe": pa.array([int(cell[0]) // STRIPE], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})


def _class_of(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def _pack_prefixes(level: np.ndarray, parts: int, num: int, den: int):
    """Packs the prefixes of sets by part of the token space: one row per chunk of documents and part."""

    def run(batches):
        owners, sizes, alone, tokens, seen, total = [], [], [], [], set(), 0

        def flush():
            token, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])
            part = (token >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            token, owner, part = token[order], owner[order], part[order]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            own = np.array([(*x, 0) for x in zip(owners, sizes, alone, strict=True)], _OWNER)
            rows = []
            for a, z in zip(cut, [*cut[1:], len(token)], strict=True):
                used, held = np.unique(owner[a:z], return_counts=True)
                x = own[used]
                x["held"] = held
                rows.append((int(part[a]), token[a:z].tobytes(), x.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["part", "tokens", "owners"])

        for b in batches:
            for text in b.column(0):
                s = shingle_set(text.as_py())
                if not len(s) or (c := _class_of(set_digest(s))) in seen:
                    continue
                seen.add(c)
                p = int(prefix_length(len(s), num, den))
                steps = level[_cell(s)]
                rare = s[np.argsort(steps, kind="stable")[:p]]
                owners.append(c)
                sizes.append(len(s))
                alone.append(int(np.count_nonzero(steps == 0)) * 65535 // len(s))
                tokens.append(rare)
                total += len(rare)
                if total >= CHUNK_TOKENS // 2:
                    yield flush()
                    owners, sizes, alone, tokens, seen, total = [], [], [], [], set(), 0
        if tokens:
            yield flush()

    return run


def _shared_runs(table: pa.Table) -> pa.Table:
    """Of one part, the entries of tokens that two classes or more hold, with the run's pivot.

    The pivot is the class of the run, in the same band of set sizes, with the smallest share of
    tokens that the sketch does not know, which is likely in the middle of a group.
    """
    token = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")])
    owner = np.concatenate([np.frombuffer(x.as_buffer(), _OWNER) for x in table.column("owners")])
    own = np.repeat(np.arange(len(owner), dtype=np.int32), owner["held"])
    # most tokens occur once: drop them before anything else is looked up
    order = np.argsort(token, kind="stable")
    token = token[order]
    same = np.concatenate([[False], token[1:] == token[:-1], [False]])
    twice = same[1:] | same[:-1]
    token, own = token[twice], own[order[twice]]
    del order, same, twice
    cls, n, alone = (owner[c][own].astype(np.int64) for c in ("cls", "n", "alone"))
    order = np.lexsort((cls, token))
    token, cls, n, alone = token[order], cls[order], n[order], alone[order]
    first = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]) if len(token) else np.zeros(0, bool)
    token, cls, n, alone = token[first], cls[first], n[first], alone[first]
    new = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    many = (np.bincount(run)[run] > 1) if len(run) else np.zeros(0, bool)
    token, cls, n, alone = token[many], cls[many], n[many], alone[many]
    band = np.floor(np.log(n) / np.log(4 / 3)).astype(np.int64)
    order = np.lexsort((cls, alone, band, token))
    token, cls, n, band = token[order], cls[order], n[order], band[order]
    head = np.concatenate([[True], (token[1:] != token[:-1]) | (band[1:] != band[:-1])]) if len(token) else np.zeros(0, bool)
    pivot = cls[head][np.cumsum(head) - 1] if len(token) else cls
    return pa.table({"token": token.view(np.int64), "cls": cls, "n": n, "band": band, "pivot": pivot})


def _with_set(batches):
    for b in sliced(batches):
        sets = [shingle_set(t.as_py()) for t in b.column(0)]
        cls = [_class_of(set_digest(x)) if len(x) else None for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "tokens"])


def _search_group(num: int, den: int):
    """Of a block of an opened group and a block of the classes it is opened for, the links as a forest.

    ``tokens`` of the group lie sorted beside their members, so that one search per token of a class
    counts its intersections with all members at once.  ``tied`` members are one component already.
    A class gets one link per component that the block knows, not one per member, and joins them.
    """

    def run(table: pa.Table) -> pa.Table:
        cls, tied, role = (table.column(c).to_numpy() for c in ("cls", "tied", "role"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        member, query = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        found = []
        if len(member) and len(query):
            n = np.array([len(sets[k]) for k in member])
            token, owner = np.concatenate([sets[k] for k in member]), np.repeat(np.arange(len(member)), n)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            value, start = np.unique(token, return_index=True)
            end = np.append(start[1:], len(token))
            known = {int(c): k for k, c in enumerate(cls[member])}
            tree = np.where(tied[member], -1, np.arange(len(member)))  # the tied members are component -1
            for q in query:
                x = sets[q]
                at = np.searchsorted(value, x)
                at, x = at[at < len(value)], x[at < len(value)]
                hit = at[value[at] == x]
                if not len(hit):
                    continue
                length = end[hit] - start[hit]
                spread = np.repeat(start[hit] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                both = np.bincount(owner[spread], minlength=len(member))
                near = np.flatnonzero(both * den >= num * (len(sets[q]) + n - both))
                near = near[cls[member[near]] != cls[q]]
                if not len(near):
                    continue
                own = known.get(int(cls[q]))
                trees, first = np.unique(tree[near], return_index=True)
                if own is not None:
                    first = first[trees != tree[own]]
                found += [(cls[q], cls[member[near[k]]]) for k in first]
                if own is not None:  # the class is a member itself
                    trees = np.append(trees, tree[own])
                if len(trees) > 1:
                    tree[np.isin(tree, trees)] = trees.min()
        return pa.table({"a": pa.array([int(x[0]) for x in found], pa.int64()), "b": pa.array([int(x[1]) for x in found], pa.int64())})

    return run


def _open_groups(runs: DataFrame, homes: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """The groups to open for each class: ``(cls, grp)``, from the token-group matrix.

    The matrix has a row per token and a column per group, set where the union of its members' prefix
    tokens holds the token.  A class is compared with the unions, never with other classes; the cells it
    shares with a group bound its intersection with every member.  A pair of groups is looked at
    from one side: from classes without a link to linked ones, else by the order of the groups.  Groups
    of one component are settled.  ``grp`` holds a hash of the home, then ``TIED``, then the band.
    """
    # by token once: the unions are read off the same partitions
    held = runs.select("token", "cls").join(homes.select("cls", "grp"), "cls").repartition(parts, "token")
    union = held.select("token", F.col("grp").alias("g")).distinct()
    tied, t = (F.col(c).bitwiseAND(TIED) for c in ("grp", "g"))
    sides = (tied < t) | ((tied == t) & (F.col("grp") <= F.col("g")))
    settled = (tied != 0) & (t != 0) & (F.shiftright("grp", 8) == F.shiftright("g", 8))
    overlap = held.join(union, "token").where(sides & ~settled).groupBy("cls", "g").agg(F.count("*").alias("shared"))
    sizes = homes.groupBy(F.col("grp").alias("g")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    overlap = overlap.join(homes.select("cls", "n"), "cls").join(sizes, "g")

    ceil = lambda c, over: F.floor((c + over - 1) / over)
    rest = lambda c: ceil(c * num, den) - 1
    lo, hi = F.greatest("lo", ceil(F.col("n") * num, den)), F.least("hi", F.floor(F.col("n") * den / num))
    # the bound is loosest at an end of the sizes that can meet; one token of slack for its rounding
    lack = lambda m: ceil((F.col("n") + m) * num, num + den) - F.greatest(rest(F.col("n")), rest(m))
    opened = overlap.where((lo <= hi) & (F.col("shared") + 1 >= F.least(lack(lo), lack(hi))))
    return opened.select("cls", F.col("g").alias("grp"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Documents of equal sets are one class (a 128-bit digest, pre-aggregated map-side); classes are
    joined, and copies take their class's component.

    1. A pass over the texts finds set sizes, digests, and the shingles that several documents of one
       chunk hold.  A sketch of their counts in steps of an eighth of a doubling, of ``CELLS`` bytes,
       gives the global token order (rarest first, ties by hash).  A shingle of f documents is missed
       only while f is small against the square root of the number of chunks, and shingles that
       share a cell only move in the order, which changes no result.
    2. A second pass sends each class's prefix, which must share a token with any partner, to the
       tokens' parts of the token space.  Tokens of a single class end there.
    3. Groups: each class is checked with the pivot that it shares most tokens with.  Classes that
       the links connect form groups, by band of sizes; a class without a link joins the group
       of its pivot's loose classes, or is a group of its own.
    4. The token-group matrix (``_open_groups``) bounds the overlap of each class with the union of
       each group, and opens the groups that can hold a partner.
    5. An opened group is searched in blocks of its members and of the classes it is opened for;
       a class is linked once with each component that it meets there.  Components follow.

    Exact for any order and grouping, without caps; rows follow the tokens, never pairs of classes.

    Result: ``id, n_shingles, component_id``, one row per input row.  Null, empty and blank texts have
    an empty set and link with nothing; rows of a null id link with nothing and have a null
    component; repeated ids share a component; empty tables give an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    num, den = percent, 100
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    narrow = checkpointed(rows.mapInArrow(_narrow_pass, "id long, n long, sig binary, cls long, cell long, cnt long"))
    # one byte a cell for the driver and for each task
    steps = F.least(F.lit(255), F.ceil(8 * F.log2(F.sum("cnt")))).cast("short")
    known = narrow.where("cell is not null").groupBy(F.col("cell").cast("int").alias("cell")).agg(steps.alias("level"))
    known = known.groupBy(F.floor(F.col("cell") / STRIPE).alias("stripe")).applyInArrow(_stripe, "stripe int, levels binary")
    level = np.zeros(CELLS, np.uint8)
    for r in known.toLocalIterator():
        level[r.stripe * STRIPE : (r.stripe + 1) * STRIPE] = np.frombuffer(r.levels, np.uint8)
    narrow = narrow.where("cell is null").select("id", "n", "sig", "cls")
    total = narrow.agg(F.sum(F.floor(F.col("n") / 4) + 1).alias("s")).first()["s"] or 0
    parts = int(max(shuffle_width(spark), total // CHUNK_TOKENS + 1))

    packed = rows.where("id is not null").select("text").mapInArrow(_pack_prefixes(level, parts, num, den), "part int, tokens binary, owners binary")
    runs = checkpointed(packed.groupBy("part").applyInArrow(_shared_runs, "token long, cls long, n long, band long, pivot long"))

    members = narrow.where("id is not null and sig is not null").groupBy("sig", "cls").agg(F.min("id").alias("rep"))
    members = checkpointed(members)
    classes = members.select("cls", "rep")

    def search(members: DataFrame, askers: DataFrame) -> DataFrame:
        """Links between the members of groups ``(grp, cls, n, tied)`` and the classes they are opened for, in blocks."""
        wanted = members.select("cls").unionAll(askers.select("cls")).join(classes, "cls").select(F.col("rep").alias("id")).distinct()
        wanted = checkpointed(wanted)
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        sets = rows.join(wanted, "id").select("text").mapInArrow(_with_set, "cls long, tokens binary").dropDuplicates(["cls"])
        blocks = lambda of, name: of.groupBy("grp").agg((F.floor(F.sum("n") / BLOCK_TOKENS) + 1).alias(name))
        count = blocks(members, "mb").join(blocks(askers, "qb"), "grp")

        def placed(of: DataFrame, own: str, other: str, role: int) -> DataFrame:
            """The rows of a side, in a block of its own and once for each block of the other side."""
            of = of.join(count, "grp").withColumn(own, F.pmod(F.xxhash64("cls"), F.col(own)))
            return of.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("grp", "mb", "qb", "cls", "tied", F.lit(role).alias("role"))

        sides = placed(members, "mb", "qb", 1).unionAll(placed(askers, "qb", "mb", 0)).join(sets, "cls")
        found = sides.select("grp", "mb", "qb", "cls", "tied", "role", "tokens").groupBy("grp", "mb", "qb").applyInArrow(_search_group(num, den), "a long, b long")
        one, two = classes.select(F.col("cls").alias("a"), F.col("rep").alias("u")), classes.select(F.col("cls").alias("b"), F.col("rep").alias("v"))
        return checkpointed(found.join(one, "a").join(two, "b").select("u", "v"))

    # each class and the pivot that it shares most tokens with
    fewest = F.ceil(F.col("n") * F.lit((den - num) * num / (den * (num + den)))) - 1
    shares = runs.groupBy("cls", "n", "band", "pivot").agg(F.count("*").alias("shared"))
    other = F.when(F.col("pivot") != F.col("cls"), F.struct("shared", "pivot"))
    pivots = checkpointed(shares.groupBy("cls", "n", "band").agg(F.sum("shared").alias("held"), F.max(other).alias("best")).select("cls", "n", "band", "held", "best.*"))
    tries = pivots.where(F.col("shared") >= fewest).select(F.col("pivot").alias("grp"), "cls", "n", F.lit(False).alias("tied"))
    centres = tries.select(F.col("grp").alias("cls")).distinct().join(pivots.select("cls", "n"), "cls").select(F.col("cls").alias("grp"), "cls", "n", F.lit(False).alias("tied"))
    links = search(centres, tries)

    comp = components(links).withColumnRenamed("node", "rep")
    linked = checkpointed(classes.join(comp, "rep", "left").select("cls", F.coalesce("component", "rep").alias("home"), F.col("component").isNotNull().alias("tied")))
    near = linked.select(F.col("cls").alias("pivot"), F.col("home").alias("near"))
    close = F.col("shared") * 2 >= F.col("held")  # most of what it shares with any class
    homes = pivots.join(linked, "cls").join(near, "pivot", "left").select("cls", "n", "band", F.when(~F.col("tied") & close, F.coalesce("near", "home")).otherwise(F.col("home")).alias("home"), "tied")
    grp = F.shiftleft(F.shiftright(F.xxhash64("home"), 8), 8) + F.when(F.col("tied"), TIED).otherwise(0) + F.col("band")
    homes = checkpointed(homes.select("cls", "n", "tied", grp.alias("grp")))
    opened = checkpointed(_open_groups(runs, homes, parts, num, den))
    inside = homes.join(opened.select("grp").distinct(), "grp", "left_semi").select("grp", "cls", "n", "tied")
    links = links.unionAll(search(inside, opened.join(homes.select("cls", "n", "tied"), "cls")))

    # an id with several texts ties their classes together
    several = narrow.where("id is not null").groupBy("id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("id")
    ties = narrow.join(several, "id").join(members.select("sig", "rep"), "sig").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    comp = components(links.unionAll(ties)).withColumnRenamed("node", "rep")
    found = narrow.join(members.select("sig", "rep"), "sig", "left").join(comp, "rep", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
