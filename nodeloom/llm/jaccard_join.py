"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, so a link of distance at most ``d`` obeys the triangle inequality around any pivot. The join

1. counts every shingle over the corpus, in hash buckets of packed arrays, and drops by exact bounds each document whose
   shared shingles are too few for any link;
2. makes regions: documents which share one of their rarest shared shingles (a prefix that every linked pair meets in) get
   that shingle's pivot, and their exact distances to it are computed;
3. recurs: within a region new pivots are chosen among documents not linked to its pivot, MORE times as many in each round; each
   document goes to the Voronoi cell of its nearest pivot and, where ``d(x, q) <= d(x, own) + 2 d``, as a boundary replica to other
   cells; a region stays together until its cells have at most half as many pairs. In a cell only documents in the window
   ``|r(x) - r(y)| <= d`` stay, and of these, those whose shared shingles are enough for a link with any size that is there. A cell
   closes when its documents are of one component, and one that fits a task is finished there by the same recursion. A pivot has met
   its whole region and leaves it, so the recursion ends, and no linked pair is lost.

Exactness is up to collisions of 64-bit shingle hashes and 128-bit set fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.llm import hashing as H
from nodeloom.llm.components import components
from nodeloom.llm.scratch import light_batches, partitions, save
from nodeloom.llm.workers import free, trim

#: Shingles that a bucket of the count holds on average, and that a map task holds before it sends them.
BUCKET = FLUSH = 1 << 21
#: Pivots of a region in the first round of the recursion; shingles of a region that one task finishes, and these by documents.
PIVOTS, SMALL, SMALL_WORK = 8, 1 << 20, 1 << 30
#: How many times as many pivots each next round has, while they have at most FULL shingles: sets that link to nothing leave a region as pivots only, so the rounds are
#: counted by them. Pivots that have cells; shingles that meet the pivots in one task, and pivots that it holds distances to at once.
MORE, FULL, CELLS, CHUNK, BLOCK = 64, 1 << 22, 64, 1 << 18, 512


def _sets(batches, k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            w, _, rows = H.words(*H.text_bytes(part.column(1)))
            yield part.column(0), H.distinct_sets(*H.windows_of_words(w, rows, k))


def _describe(k: int):
    def run(batches):
        free()
        for ids, sets in _sets(batches, k):
            prints = [H.fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())],
                ["doc_id", "n_shingles", "f1", "f2"],
            )

    return run


def _by_part(part: np.ndarray, owner: np.ndarray, sets: np.ndarray, keys: np.ndarray, many: np.ndarray | None) -> tuple[list, ...]:
    """Columns (part, sets, counts, keys, many) of one packed row for each part."""
    order = np.lexsort((owner, part))
    part, owner, keys = part[order], owner[order], keys[order]
    many = many[order] if many is not None else None
    cuts, out = np.flatnonzero(np.diff(part, prepend=-1)), ([], [], [], [], [])
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        who, n = np.unique(owner[a:b], return_counts=True)
        row = (int(part[a]), sets[who].tobytes(), n.astype(np.uint32).tobytes(), keys[a:b].tobytes(), many[a:b].tobytes() if many is not None else None)
        for column, value in zip(out, row):
            column.append(value)
    return out


_PACKED = "part int, sets binary, counts binary, keys binary, many binary"
_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["part", "sets", "counts", "keys", "many"]


def _scaled(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _deal(k: int, buckets: int):
    """Packed shingles by bucket; a set that the task has met before goes out once."""

    def flush(known, sets):
        lengths = np.array([len(s) for s in sets])
        keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
        columns = _by_part(_scaled(keys, buckets), owner, np.array(known, np.int64), keys, None)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], _NAMES)

    def run(batches):
        seen, known, sets, held = set(), [], [], 0
        for _, some in _sets(batches, k):
            for s in some:
                p = H.fingerprint(s)
                if len(s) and p not in seen:
                    seen.add(p)
                    known.append((*p, len(s)))
                    sets.append(s)
                    held += len(s)
            if held >= FLUSH:
                yield flush(known, sets)
                known, sets, held = [], [], 0
        if sets:
            yield flush(known, sets)
        trim()

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sets (f1, f2, n), and the set of each key, and the keys."""
    sets = np.frombuffer(b"".join(table["sets"].to_pylist()), np.int64).reshape(-1, 3)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
    sets, which = np.unique(sets, axis=0, return_inverse=True)
    return sets, np.repeat(which.ravel(), counts), np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)


def _shared(parts: int):
    """Of one bucket: the shingles that two or more sets have, dealt anew by set, with the number of sets."""

    def run(table: pa.Table) -> pa.Table:
        sets, owner, keys = _unpacked(table)
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = new_key | np.concatenate([[True], owner[1:] != owner[:-1]])
        key = np.cumsum(new_key) - 1
        many = np.bincount(key[first])
        take = first & (many[key] > 1)
        keys, owner, many = keys[take], owner[take], many[key[take]].astype(np.uint32)
        columns = _by_part(_scaled(H.mix(sets[owner, 0].astype(np.uint64)), parts), owner, sets, keys, many)
        out = pa.table([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_NAMES)
        del sets, owner, keys, order, key, many, columns
        trim()
        return out

    return run


_CORES = "f1 long, f2 long, n long, size long, c1 long, c2 long, core binary, prefix array<long>"


def _cores(percent: int):
    """Of one part of the sets: those whose shared shingles are enough for a link, with these in order, their fingerprint, and
    the rarest of them, where a linked set must meet it."""

    def run(table: pa.Table) -> pa.Table:
        sets, owner, keys = _unpacked(table)
        many = np.frombuffer(b"".join(table["many"].to_pylist()), np.uint32)
        able = 100 * np.bincount(owner, minlength=len(sets)) >= percent * sets[:, 2]
        take = able[owner]
        keys, owner, many = keys[take], owner[take], many[take]
        order = np.lexsort((keys, many, owner))
        keys, owner = keys[order], owner[order]
        cuts, rows = np.flatnonzero(np.diff(owner, prepend=-1)), []
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            f1, f2, n = sets[owner[a]].tolist()
            core = np.sort(keys[a:b])
            rows.append((f1, f2, n, len(core), *H.fingerprint(core), core.tobytes(), keys[a : a + (b - a) - -(-percent * n // 100) + 1].astype(np.int64).tolist()))
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _CORES.split(", ")])

    return run


def _overlaps(batches):
    for batch in batches:
        a, b = batch.column("core_a").to_pylist(), batch.column("core_b").to_pylist()
        same = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(same, pa.int64())], ["a", "b", "n_a", "n_b", "same"])


class _Metric:
    """Exact overlaps of asked pairs of nodes, each computed once."""

    def __init__(self, nodes: DataFrame, percent: int):
        self.nodes, self.percent, self.known = nodes, percent, None

    def ask(self, pairs: DataFrame) -> None:
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.known is not None:
            pairs = pairs.join(self.known.select("a", "b"), ["a", "b"], "left_anti")
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("core").alias(f"core_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "core_a", "core_b")
        new = save(both.mapInArrow(_overlaps, "a long, b long, n_a long, n_b long, same long"), "overlaps")
        self.known = new if self.known is None else self.known.unionByName(new)

    def add(self, overlaps: DataFrame) -> None:
        self.known = self.known.unionByName(save(overlaps, "overlaps"))

    def linked(self) -> DataFrame:
        return self.known.where(f"100 * same >= {self.percent} * (n_a + n_b - same)").select("a", "b")

    def distances(self, rows: DataFrame, to: str) -> DataFrame:
        """``rows`` with r, the distance of its node to its column ``to``."""
        r = 1 - F.col("same") / (F.col("n_a") + F.col("n_b") - F.col("same"))
        known = self.known.select(F.col("a").alias("lo"), F.col("b").alias("hi"), r.alias("r"))
        rows = rows.withColumns({"lo": F.least("node", to), "hi": F.greatest("node", to)})
        return rows.join(known, ["lo", "hi"], "left").withColumn("r", F.when(F.col("node") == F.col(to), 0.0).otherwise(F.col("r"))).drop("lo", "hi")


def _open(cells: DataFrame, limit: float) -> DataFrame:
    """Of (region, node, part, n, most, wide, r): what is still to be joined; of regions of the same documents, one.

    part is the component known so far; most is the largest set that the node's shared shingles are enough for. A region closes when
    it has one part and no wide node.
    """
    fits = cells.groupBy("region").agg(F.min("n").alias("least"), F.max("most").alias("largest"))
    cells = cells.join(fits, "region").where("most >= least and n <= largest").drop("least", "largest")
    sizes = cells.groupBy("region", "part").agg(F.count("*").alias("size"))
    main = sizes.groupBy("region").agg(F.max(F.struct("size", "part")).getField("part").alias("main"))
    cells = cells.join(main, "region").withColumn("free", F.expr("wide or part <> main")).drop("main")
    reach = cells.where("free").groupBy("region").agg((F.min("r") - limit).alias("low"), (F.max("r") + limit).alias("high"))
    cells = cells.join(reach, "region").where("free or (r >= low and r <= high)").drop("low", "high")
    mark = cells.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"))
    one = mark.where("size > 1").groupBy("size", "weight", "mark").agg(F.min("region").alias("region"))
    return cells.join(one.select("region", F.expr(f"weight <= {SMALL} and size * weight <= {SMALL_WORK}").alias("small")), "region")


def _finish(percent: int):
    """The same recursion within one region that fits a task: pairs whose links join whatever all links join, and all links of a wide node."""
    limit = 1 - percent / 100 + 1e-9

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, n, wide = (table[c].to_numpy() for c in ("node", "n", "wide"))
        cores = [np.frombuffer(c, np.uint64) for c in table["core"].to_pylist()]
        lengths = np.array([len(c) for c in cores])
        part, out = np.unique(table["part"].to_numpy(), return_inverse=True)[1], []
        cells = [np.arange(len(node))]
        while cells:
            among = cells.pop()
            while len(among) > 1:
                size = np.bincount(part[among], minlength=len(node))
                outside = among[(part[among] != size.argmax()) | wide[among]]
                if not len(outside):  # one part: whatever links in here joins nothing new
                    break
                keys, owner = np.concatenate([cores[x] for x in among]), np.repeat(np.arange(len(among)), lengths[among])
                pivots, left = outside[:PIVOTS], np.ones(len(among), bool)
                far = np.ones((len(pivots), len(among)))
                for i, pivot in enumerate(pivots):
                    core = cores[pivot]
                    at = np.minimum(np.searchsorted(core, keys), len(core) - 1)
                    same = np.bincount(owner[core[at] == keys], minlength=len(among))
                    far[i] = 1 - same / (n[among] + n[pivot] - same)
                    left[np.searchsorted(among, pivot)] = False
                    linked = left & (100 * same >= percent * (n[among] + n[pivot] - same))
                    for x in np.flatnonzero(linked):
                        out.append((node[pivot], node[among[x]], n[pivot], n[among[x]], same[x]))
                    for other in np.unique(part[among[linked]]):
                        part[part == other] = part[pivot]
                # The pivots have met everyone. Voronoi cells with boundary replicas: a linked pair lies whole in the cell of either's nearest pivot.
                among, far = among[left], far[:, left]
                if not len(among):
                    break
                inside = far <= far.min(axis=0) + 2 * limit
                if (inside.sum(axis=1) ** 2).sum() <= len(among) ** 2 / 2:  # pairs halve at least, so replicas can't add up
                    cells += [among[own] for own in inside if own.sum() > 1]
                    break
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_a", "n_b", "same"])

    return run


def _same(keys: np.ndarray, owner: np.ndarray, n: int, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of ``n`` sets, a row each, with each of the others; ``keys`` are in order of their owners."""
    out = np.zeros((n, len(others)), np.int32)
    step = max(1, min(32, (1 << 18) // max((len(o) for o in others), default=1)))
    for at in range(0, len(others), step):
        some = others[at : at + step]
        every, place = np.unique(np.concatenate(some), return_inverse=True)
        there = np.zeros((len(every), len(some)), np.uint8)
        there[place, np.repeat(np.arange(len(some)), [len(o) for o in some])] = 1
        found = np.minimum(np.searchsorted(every, keys), len(every) - 1)
        hit = every[found] == keys
        found, rows = found[hit], owner[hit]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        if len(first):
            out[rows[first], at : at + step] = np.add.reduceat(there[found], first, axis=0, dtype=np.int32)
    return out


_MET = "region string, node long, n long, wide boolean, most long, rank int, far array<double>, links array<struct<pivot: long, n: long, same: long>>"


def _meet(percent: int):
    """Some nodes of a region with their distances to its first CELLS pivots, and which of all its pivots they link to."""
    link = pa.struct([("pivot", pa.int64()), ("n", pa.int64()), ("same", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        nodes, pivots = table.filter(pc.invert(table["is_pivot"])), table.filter(table["is_pivot"]).sort_by("rank")
        core = lambda t: [np.frombuffer(c, np.uint64) for c in t["core"].to_pylist()]
        cores, others, n, size = core(nodes), core(pivots), nodes["n"].to_numpy(), pivots["n"].to_numpy()
        node, pivot = nodes["node"].to_numpy(), pivots["node"].to_numpy()
        keys = np.concatenate(cores) if cores else np.zeros(0, np.uint64)
        owner, again = np.repeat(np.arange(len(cores)), [len(c) for c in cores]), np.isin(node, pivot)
        met = []
        for at in range(0, len(pivot), BLOCK):
            some = slice(at, at + BLOCK)
            same = _same(keys, owner, len(cores), others[some])
            union = n[:, None] + size[some] - same
            if not at:
                far = (1 - same[:, :CELLS] / union[:, :CELLS]).astype(float)
            # Two pivots meet twice and count once.
            linked = (100 * same.astype(np.int64) >= percent * union) & ~(again[:, None] & (node[:, None] <= pivot[some]))
            who, which = np.nonzero(linked)
            met.append((who, which + at, same[who, which]))
        who, which, same = (np.concatenate(x) for x in zip(*met))
        order = np.argsort(who, kind="stable")
        which, same, ends = which[order], same[order].astype(np.int64), np.cumsum(np.bincount(who, minlength=len(cores)))
        links = pa.StructArray.from_arrays([pa.array(pivot[which]), pa.array(size[which]), pa.array(same)], fields=list(link))
        links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), links)
        far = pa.ListArray.from_arrays(pa.array(np.arange(len(cores) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
        out = nodes.select(["region", "node", "n", "wide", "most", "rank"])
        return out.append_column("far", pa.chunked_array([far])).append_column("links", pa.chunked_array([links]))

    return run


def _met(cells: DataFrame, nodes: DataFrame, pivots: int, percent: int) -> DataFrame:
    """Of each region its nodes after they have met its pivots, which have a rank."""
    order = W.partitionBy("region").orderBy(F.xxhash64("node"), "node")
    free = cells.where("free").withColumns({"rank": F.row_number().over(order), "weight": F.sum("n").over(order)})
    chosen = free.where(f"rank <= {PIVOTS} or rank <= {pivots} and weight <= {FULL}").select("region", "node", "n", "rank")
    chunks = cells.groupBy("region").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    cores = nodes.select("node", "core")
    own = cells.select("region", "node", "n", "wide", "most").join(chosen.select("region", "node", "rank"), ["region", "node"], "left")
    own = own.join(chunks, "region").withColumns({"chunk": F.pmod(F.xxhash64("node"), "chunks").cast("int"), "is_pivot": F.lit(False)})
    to = chosen.join(chunks, "region").join(cores, "node").withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "is_pivot": F.lit(True)})
    both = own.join(cores, "node").drop("chunks").unionByName(to.drop("chunks"), allowMissingColumns=True)
    return both.groupBy("region", "chunk").applyInArrow(_meet(percent), _MET)


def _split(met: DataFrame, limit: float) -> DataFrame:
    """Voronoi cells with boundary replicas of regions that they take apart; the other regions whole, without their pivots."""
    near = met.where("rank is null").select("region", "node", "n", "wide", "most", (F.array_min("far") + 2 * limit).alias("edge"), F.posexplode("far").alias("cell", "r"))
    sizes = near.groupBy("region", "cell").agg(F.count("*").alias("size"), F.count_if(F.expr("r <= edge")).alias("inside"))
    # Pairs halve at least and rows double at most, so that replicas can't add up.
    apart = sizes.groupBy("region").agg(F.expr("2 * sum(inside * inside) <= max(size) * max(size) and sum(inside) <= 2 * max(size)").alias("apart"))
    near = near.join(apart, "region").where("if(apart, r <= edge, cell = 0)")
    return near.select(F.expr("if(apart, concat_ws('/', region, cell), region)").alias("region"), "node", "n", "wide", "most", "r")


def _join(nodes: DataFrame, percent: int) -> _Metric:
    """Overlaps of a set of pairs whose links join whatever all links join; with ``wide`` nodes, all their links."""
    limit = 1 - percent / 100 + 1e-9
    metric = _Metric(nodes.select("node", "n", "core"), percent)
    most = F.expr(f"size * (100 + {percent}) div {percent} - n").alias("most")
    places = nodes.select("node", "n", "wide", most, F.explode("prefix").alias("key"))
    pivots = places.groupBy("key").agg(F.min("node").alias("region"), F.count("*").alias("size")).where("size > 1").drop("size")
    cells = save(places.join(pivots, "key").select("region", "node", "n", "wide", "most").distinct(), "regions")
    metric.ask(cells.select(F.col("region").alias("a"), F.col("node").alias("b")))
    cells = metric.distances(cells, "region").where("node <> region")
    cells = cells.withColumns({"part": F.when(F.col("r") <= limit, F.col("region")).otherwise(F.col("node")), "region": F.col("region").cast("string")})
    each = PIVOTS
    while True:
        cells = save(_open(cells, limit), "regions")
        sizes = cells.agg(F.count_if("small"), F.count_if(~F.col("small"))).first()
        if sizes[0]:
            small = cells.where("small").join(nodes.select("node", "core"), "node").select("region", "node", "part", "n", "wide", "core")
            metric.add(small.groupBy("region").applyInArrow(_finish(percent), "a long, b long, n_a long, n_b long, same long"))
        if not sizes[1]:
            return metric
        cells = cells.where("not small").drop("small")
        met = save(_met(cells, nodes, each, percent), "met")
        each *= MORE
        metric.add(met.select("node", "n", F.explode("links").alias("x")).select(F.col("x.pivot").alias("a"), F.col("node").alias("b"), F.col("x.n").alias("n_a"), F.col("n").alias("n_b"), F.col("x.same").alias("same")))
        cells = _split(met, limit)
        parts = components(metric.linked()).select("node", F.col("component").alias("part"))
        cells = cells.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Texts lose the case of A-Z; words are runs without white space. Two rows link when the Jaccard similarity of their sets of
    ``words``-word shingles is ``percent`` per cent or more. component_id is the smallest id that links reach.

    Null and empty texts have no shingles and link with nothing, not with each other. Rows of one id but different texts are
    nodes of one name: the component holds what either reaches. Rows with a null id have a null component. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    light_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = save(texts.mapInArrow(_describe(words), "doc_id long, n_shingles long, f1 long, f2 long"), "described")
    classes = save(rows.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")), "classes").where("node is not null")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET))
    dealt = texts.select("doc_id", "text").mapInArrow(_deal(words, buckets), _PACKED)
    shared = dealt.groupBy("part").applyInArrow(_shared(buckets), _PACKED)
    cores = shared.groupBy("part").applyInArrow(_cores(percent), _CORES).join(classes.select("f1", "f2", "node"), ["f1", "f2"])
    cores = save(cores.drop("f1", "f2"), "cores")

    # Sets with the same shared shingles: one stands for all. It links to whatever a longer one links to.
    heads = cores.groupBy("c1", "c2").agg(F.min(F.struct("n", "node")).alias("head"))
    heads = heads.select("c1", "c2", F.col("head.n").alias("head_n"), F.col("head.node").alias("head"))
    members = save(cores.select("c1", "c2", "node", "n", "size").join(heads, ["c1", "c2"]).withColumn("near", F.expr(f"100 * size >= {percent} * (n + head_n - size)")).drop("c1", "c2"), "members")
    strays = members.where("node <> head and not near")
    wide = strays.select(F.col("head").alias("node")).distinct().withColumn("wide", F.lit(True))
    nodes = save(cores.join(members.where("node = head").select("node"), "node", "left_semi").join(wide, "node", "left").withColumn("wide", F.coalesce("wide", F.lit(False))), "nodes")
    metric = _join(nodes, percent)
    ends = lambda a, b: metric.known.select(F.col(a).alias("head"), F.expr(f"same * (100 + {percent}) / {percent} - n_{b} + 1e-9").alias("longest"))
    longest = ends("a", "b").unionByName(ends("b", "a")).groupBy("head").agg(F.max("longest").alias("longest"))
    edges = metric.linked().unionByName(members.where("near").select(F.col("head").alias("a"), F.col("node").alias("b")))
    edges = edges.unionByName(strays.join(longest, "head").where("n <= longest").select(F.col("head").alias("a"), F.col("node").alias("b")))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id")
    copies = rows.where("n_shingles > 0 and doc_id is not null").join(classes.where("copies > 1"), ["f1", "f2"])
    again = rows.where("n_shingles > 0").join(repeated, "doc_id").join(classes, ["f1", "f2"])
    edges = edges.unionByName(again.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    edges = edges.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    found = components(edges)
    return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


#: The same in SQL: every pair that shares a shingle is counted, and links are followed from each document.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * same >= 75 * (na + nb - same) UNION ALL SELECT b, a FROM pairs WHERE 100 * same >= 75 * (na + nb - same)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = doc_id
"""
