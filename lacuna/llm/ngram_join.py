"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

The incidence of documents by n-grams is multiplied with its transpose one block of
columns at a time.  Columns are ordered rare to frequent, and each document enters the
first block with a size-derived prefix of its columns only: documents of n n-grams that
reach similarity t share their first ``EXTRA`` common columns within the first
n - ceil(t n) + EXTRA, so pairs whose accumulated count stays below that are discarded.
What remains is multiplied block after block over all columns, and a pair is discarded
as soon as its count and what is left of the shorter rest stay below what t needs.

Pairs are held back in these ways; what they leave open is said below:

* Documents with equal sets are one class from the start.
* An entry (document, column) is dropped before any pair is made if the document cannot
  link through it: what its rarer columns lose to all others bounds the overlap, and so
  the partner's size.
* A column of at most ``LONG`` documents pairs them all, a bounded number for each.
* A longer one first multiplies with its lead document alone (the one closest to being
  all frequent columns, so the origin of its copies).  Members that this leaves outside
  the lead's component then meet others by equi-joins on column and size: only where
  the column can be the first common one, which leaves each a band of partner sizes.
  Texts made from one template, alike but below the threshold, do not meet at all.

Texts that share long columns and not the order of their rarest ones (pages of the same
few lines, shuffled) still meet in the square of their number: bounds are applied to the
joined rows, not in the join's key.  2,000 such pages gave 251,050 joined rows for 3 links.

Defined results
    null or blank texts have no n-grams and link with nothing; texts with fewer words
    than n have one n-gram; rows that share a ``doc_id`` must share the text; a null ``doc_id``
    gives a null component; texts of any length are taken whole; ties in size and order
    change nothing; extra columns are ignored, the result has its own; an empty table
    gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.components import connected_components
from lacuna.llm.runtime import small_batches, stash, table, trimmed
from lacuna.llm.wordhash import shingles

#: Common columns that two linked documents must show within their prefixes.
EXTRA = 4
#: Columns longer than this meet their lead document first.
LONG = 16
#: Frequent n-grams whose order by frequency is known to every task: at most 2^18
#: (16 bytes each), those above a count that is found from a histogram of the counts.
FREQUENT, FREQUENT_LEAST = 1 << 18, 4
#: Ids broadcast to filter a scan; beyond it the same join is shuffled.
BROADCAST_IDS = 250_000
#: Columns of a block of the whole product; pairs of one document that one task holds.
COLUMNS, HOT_PAIRS = 1024, 2000
#: Bands of sizes in which documents meet: of a hundredth.
BANDS = 100
#: Codes counted at once inside a task.
FLUSH = 1 << 21
SEEN_IN_TASK = 2


def _survey(size: int, lower: bool):
    """Rows (0, doc_id, n, 128-bit key of the set) and, for n-grams met repeatedly in
    the task, (1, null, times, code)."""

    def run(batches):
        parts, held = [], 0

        def frequent():
            codes, times = np.unique(np.concatenate(parts), return_counts=True)
            most = times >= SEEN_IN_TASK
            codes, times = codes[most].view(np.int64), times[most]
            k = len(codes)
            return pa.record_batch([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(times.astype(np.int64)), pa.array(codes), pa.array(np.zeros(k, np.int64))], names=["kind", "doc_id", "n", "k1", "k2"])

        for batch in batches:
            ids, n, k1, k2 = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                codes = shingles(text, size, lower)
                key = xxhash.xxh3_128_digest(codes.tobytes())
                n.append(len(codes))
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                parts.append(codes)
                held += len(codes)
                if held >= FLUSH:
                    yield frequent()
                    parts, held = [], 0
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int32)), ids, pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], names=["kind", "doc_id", "n", "k1", "k2"])
        if held:
            yield frequent()

    return run


def _prefixes(size: int, lower: bool, percent: int, frequent):
    """Rows (doc_id, n, columns): the prefix in the order (frequency, code)."""

    def run(batches):
        codes_f, times_f = frequent.value
        for batch in batches:
            ids, n, cols = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = shingles(text, size, lower)
                if not len(codes) or doc_id is None:
                    continue
                rank = np.zeros(len(codes), np.int64)
                if len(codes_f):
                    at = np.minimum(np.searchsorted(codes_f, codes), len(codes_f) - 1)
                    rank = np.where(codes_f[at] == codes, times_f[at], 0)
                keep = min(len(codes), len(codes) - -(-percent * len(codes) // 100) + EXTRA)
                ids.append(doc_id)
                n.append(len(codes))
                cols.append(codes[np.lexsort((codes, rank))[:keep]].view(np.int64))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cols, pa.list_(pa.int64()))], names=["id", "n", "cols"])

    return run


def _sets(size: int, lower: bool):
    def run(batches):
        for batch in batches:
            rows = [shingles(text, size, lower).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["id", "codes"])

    return run


def overlap(a: np.ndarray, b: np.ndarray, percent: int, block: int = COLUMNS) -> int | None:
    """Common codes of two sorted sets, a block of columns after another; None as soon
    as they cannot reach the similarity any more."""
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    common = at = 0
    for begin in range(0, len(a), block):
        if common + min(len(a) - begin, len(b) - at) < need:
            return None
        part = a[begin : begin + block]
        upto = len(b) if begin + block >= len(a) else int(np.searchsorted(b, part[-1], side="right"))
        common += len(np.intersect1d(part, b[at:upto], assume_unique=True))
        at = upto
    return common if common >= need else None


def _overlaps(percent: int):
    def run(batches):
        for batch in batches:
            common = [overlap(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(common, pa.int64())], names=["x", "y", "common"])

    return run


def _of_these(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` of ``ids``: a broadcast filter of the scan while the ids are few."""
    ids = stash(ids.distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _links(docs: DataFrame, pairs: DataFrame, size: int, lower: bool, percent: int) -> DataFrame:
    """The pairs ``(x, y, nx, ny)`` whose full product reaches the threshold."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id"))
    sets = stash(_of_these(docs, ids).dropDuplicates(["id"]).mapInArrow(trimmed(_sets(size, lower)), "id long, codes binary"), "sets")
    joined = _with_sets(_with_sets(pairs.select("x", "y"), pairs, sets, "y", "x"), pairs, sets, "x", "y")
    counted = joined.select("x", "y", "codes_x", "codes_y").mapInArrow(trimmed(_overlaps(percent)), "x long, y long, common long")
    return stash(counted.where("common IS NOT NULL").select("x", "y"), "links")


def _with_sets(joined: DataFrame, pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """``joined`` with the set of each pair's ``end``.  An end of very many pairs is spread
    over as many keys as it has ``HOT_PAIRS`` pairs, and its set is repeated for each."""
    hot = pairs.groupBy(F.col(end).alias("id")).agg(F.ceil(F.count(F.lit(1)) / HOT_PAIRS).cast("int").alias("parts")).where("parts > 1")
    hot = stash(hot, "hot")
    if hot.isEmpty():
        return joined.join(sets.select(F.col("id").alias(end), F.col("codes").alias(f"codes_{end}")), end)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    spread = joined.join(hot.withColumnRenamed("id", end), end, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = sets.join(hot, "id", "left").select(F.col("id").alias(end), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("codes").alias(f"codes_{end}"))
    return spread.join(copies, [end, "part"]).drop("part")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their counts, at most ``FREQUENT``: all from some count up."""
    least, held = None, 0
    for r in sorted(counts.groupBy(F.floor(F.log2("times") * 8).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("least")).collect(), key=lambda r: -r.bucket):
        held += r.n
        if held > FREQUENT:
            break
        least = r.least
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.col("times") >= least).toArrow()
    codes = rows.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    return codes[order], rows.column("times").to_numpy()[order]


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80, lower: bool = True, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(membership, links)``.

    membership: a row per input row, ``doc_id, n_shingles, class_id, component_id``;
    a class is the documents with equal sets, named by its smallest id.
    links: pairs of class names whose similarity is ``percent`` / 100 or more, enough
    of them to connect every component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    survey = stash(docs.mapInArrow(trimmed(_survey(size, lower)), "kind int, doc_id long, n long, k1 long, k2 long"), "survey")
    rows = survey.where("kind = 0").select("doc_id", "n", "k1", "k2")
    classes = stash(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("class_id")), "classes")

    counts = stash(survey.where("kind = 1").groupBy(F.col("k1").alias("code")).agg(F.sum("n").alias("times")).where(f"times >= {FREQUENT_LEAST}"), "counts")
    frequent = spark.sparkContext.broadcast(_frequent(counts))

    prefixes = docs.mapInArrow(trimmed(_prefixes(size, lower, percent, frequent)), "id long, n long, cols array<long>")
    heads = prefixes.join(classes.select(F.col("class_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", "n"])
    entries = heads.select("id", "n", F.posexplode("cols").alias("pos", "col"))
    columns = entries.groupBy("col").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct("pos", "n", "id")).alias("lead")).where("length > 1")

    def partner(most: str) -> str:
        """The largest partner of a document of n n-grams with ``most`` common ones."""
        return f"(100 * ({most}) div {percent} + ({most}) - n)"

    def bound(x: str, y: str) -> str:
        most = f"least(m{x}, m{y}) + least(n{x} - p{x}, n{y} - p{y})"
        return f"100 * ({most}) >= {percent} * (n{x} + n{y} - ({most}))"

    # Columns that one document alone shows in its prefix are lost to each of its pairs
    # that meet further on: only the ``met`` other columns before this one can match.
    met_before = F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1
    entries = entries.join(columns, "col").withColumn("met", met_before)
    entries = stash(entries.where(f"{partner('met + n - pos')} >= ceil({percent} * n / 100)"), "entries")

    lost = "least(nx - px, ny - py)"  # of the first common column: nothing before it is common
    reach = f"100 * {lost} >= {percent} * (nx + ny - {lost})"
    needed = f"least({EXTRA}, ceil({percent} * greatest(nx, ny) / 100))"

    def accumulated(found: DataFrame) -> DataFrame:
        """``(x, y, nx, ny, counted, near)`` from rows of a common column each."""
        return found.groupBy("x", "y").agg(F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.sum("counts").alias("counted"), F.expr(f"max(IF({reach}, 1, 0)) AS near")).where("near = 1")

    led = entries.where(f"length > {LONG} AND id <> lead.id").selectExpr("lead.id AS x", "id AS y", "lead.n AS nx", "n AS ny", "lead.pos AS px", "pos AS py", "lead.pos AS mx", "met AS my").where(bound("x", "y"))
    first = _links(docs, stash(accumulated(led.withColumn("counts", F.lit(1))).where(f"counted >= {needed}"), "pairs"), size, lower, percent)
    so_far = stash(connected_components(first, "x", "y"), "components")

    named = entries.join(so_far.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    lead_comp = so_far.select(F.col("node").alias("lead_id"), F.col("component").alias("lead_component"))
    named = named.withColumn("lead_id", F.col("lead.id")).join(lead_comp, "lead_id", "left")
    named = named.withColumn("long", F.col("length") > LONG).withColumn("outside", F.col("comp") != F.coalesce("lead_component", "lead_id"))
    named = stash(named.select("col", "pos", "met", "id", "n", "comp", "long", "outside"), "named")

    def side(rows: DataFrame, k: str, *more: str) -> DataFrame:
        return rows.selectExpr("col", f"id AS {k}", f"n AS n{k}", f"pos AS p{k}", f"met AS m{k}", f"comp AS c{k}", *more)

    def pairs_of(met: DataFrame, counts: int) -> DataFrame:
        return met.where(f"ca <> cb AND {bound('a', 'b')}").select(
            F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.expr("IF(a < b, na, nb) AS nx"), F.expr("IF(a < b, nb, na) AS ny"),
            F.expr("IF(a < b, pa, pb) AS px"), F.expr("IF(a < b, pb, pa) AS py"), F.lit(counts).alias("counts"),
        )

    short, long = named.where("NOT long"), named.where("long")
    found = pairs_of(side(short, "a").join(side(short, "b"), "col").where("a < b"), 1)
    # In a long column the smaller document looks for partners of the sizes that it can
    # reach if the column is their first common one; two insiders of the lead never meet.
    band = f"CAST(floor({BANDS} * ln(n)) AS INT)"
    asks = long.where(f"{partner('n - pos')} >= n").withColumn("upto", F.expr(partner("n - pos")))
    asks = asks.withColumn("band", F.expr(f"explode(sequence({band}, CAST(floor({BANDS} * ln(upto)) AS INT)))"))
    held = long.withColumn("band", F.expr(band))
    for asking, holding in ((asks.where("outside"), held), (asks.where("NOT outside"), held.where("outside"))):
        met = side(asking, "a", "band", "upto").join(side(holding, "b", "band"), ["col", "band"]).where("nb BETWEEN na AND upto AND a <> b AND (na < nb OR a < b)")
        found = found.union(pairs_of(met, 0))
    some = stash(accumulated(found), "some")
    longs = stash(long.groupBy("id").agg(F.collect_list("col").alias("longs")), "longs")
    unsure = some.where(f"counted < {needed}")
    for end in ("x", "y"):
        unsure = unsure.join(longs.select(F.col("id").alias(end), F.col("longs").alias(f"longs_{end}")), end)
    unsure = unsure.where(f"counted + size(array_intersect(longs_x, longs_y)) >= {needed}").select(*some.columns)
    pairs = stash(some.where(f"counted >= {needed}").union(unsure), "pairs")
    links = first.union(_links(docs, pairs, size, lower, percent))
    parts = stash(connected_components(links, "x", "y"), "components")
    named_classes = stash(classes.join(parts, F.col("class_id") == F.col("node"), "left").select("n", "k1", "k2", "class_id", F.coalesce("component", "class_id").alias("component_id")), "classes")
    membership = rows.join(named_classes, ["n", "k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    return membership, links


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the smallest id; columns of ``docs``."""
    membership, _ = ngram_join(docs, size, percent)
    going = stash(membership.where("component_id < doc_id").select("doc_id").distinct(), "going")
    few = going.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(going) if few else going, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    membership, _ = ngram_join(table(spark, sf_dir, "documents"), 3, 90)
    return membership.select("doc_id", "n_shingles", "component_id", "class_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2]) END) AS grams FROM w),
e AS MATERIALIZED (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
k AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
u AS MATERIALIZED (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r(node, reach) AS (SELECT x, y FROM u UNION SELECT r.node, u.y FROM r JOIN u ON r.reach = u.x),
c AS (SELECT node, min(reach) AS m FROM r GROUP BY 1),
f AS (SELECT list_sort(grams) AS grams, min(doc_id) AS class_id FROM s WHERE len(grams) > 0 GROUP BY 1)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id, coalesce(f.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON s.doc_id = c.node LEFT JOIN f ON list_sort(s.grams) = f.grams
"""
