"""Fuzzy line dedup by MinHash, in DataFrame functions only: character shingles, banding, exact Jaccard, union-find."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltloom.llm.common import components, lookup, saved


#: Lookup tables of two or three numbers a row are broadcast up to this many rows.
NARROW = 1_000_000


@dataclass(frozen=True)
class Fuzzy:
    """Lines are alike from ``percent`` of Jaccard similarity of their sets of ``shingle`` characters (UTF-16 units) on.

    ``bands`` x ``rows`` minima of one permutation: a pair of similarity 0.8 meets in a band with probability 0.995, one of 0.2 with 0.016; ``spare``: shingles a bin
    that reach the aggregation, on average. About ``block`` members of a bucket, of about ``units`` characters at most, are compared with each other in a row.
    """

    shingle: int = 8
    percent: int = 80
    bands: int = 10
    rows: int = 4
    spare: int = 2
    block: int = 256
    units: int = 1 << 20

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, pos, line): the parts between line feeds that aren't blank, numbered from 0; th is a hash of the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.split(F.col(text), "\n", -1).alias("parts"))  # once a text, not once a line
    lines = rows.select("doc_id", "th", F.posexplode("parts").alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"\S"))


def line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line, F.length(line)).alias("h2")]


def shingle_at(units: Column, i: Column, n: int) -> Column:
    """Hash of the n UTF-16 units from place i (0-based) on; of all of them if the line is shorter."""
    return F.xxhash64(F.substring(units, 2 * i + 1, F.lit(2 * n)))


def last_place(line: Column, n: int) -> Column:
    return F.greatest(F.lit(0), (F.octet_length(line) / 2).cast("int") - n)


def shingle_set(units: Column, n: int) -> Column:
    """Distinct shingle hashes. The units pass through an array of one, whose element a lambda reads in place; a column it would copy for each place."""
    own = F.transform(F.array(units), lambda u: F.transform(F.sequence(F.lit(1), 2 * last_place(u, n) + 1, F.lit(2)), lambda at: F.xxhash64(F.substring(u, at, F.lit(2 * n)))))
    return F.array_distinct(F.element_at(own, 1))


def sketch_lines(lines: DataFrame, fuzzy: Fuzzy) -> DataFrame:
    """Each distinct line once: (id, h1, h2, times, size, bands), size its places of shingles. One pass and one aggregation by the line's hash, with partial
    minima in the task that splits the line, so that neither texts nor shingles are exchanged. Empty bins take the next full one.

    Of a line with many shingles only those with small hashes reach the aggregation (``spare`` a bin on average): where a bin gets one, it gets its
    true minimum. Lines that repeat their own shingles may leave more than a quarter of the bins empty so; these few are sketched from all shingles.
    """
    first = saved(_banded(_minima(lines, fuzzy, True), fuzzy).withColumn("id", F.monotonically_increasing_id()))
    poor = saved(first.where("poor").select("h1", "h2"))
    kept = first.select("id", "h1", "h2", "times", "size", "bands")
    if poor.isEmpty():
        return kept
    h1, h2 = line_key(F.col("line"))
    whole = _minima(lookup(lines.withColumns({"h1": h1, "h2": h2}), poor, ["h1", "h2"], "inner", NARROW), fuzzy, False)
    again = saved(_banded(whole, fuzzy).withColumn("id", -1 - F.monotonically_increasing_id()).select(*kept.columns))
    return first.where("not poor").select(*kept.columns).unionByName(again)


def _banded(minima: DataFrame, fuzzy: Fuzzy) -> DataFrame:
    """(h1, h2, times, size, bands, poor): band keys; an empty bin takes the next full one. ``poor`` marks thinned lines with over a quarter of the bins empty."""
    columns = [F.col(f"m{i}") for i in range(fuzzy.bins)]
    empty = sum((F.when(m.isNull(), 1).otherwise(0) for m in columns), F.lit(0))
    near = [F.coalesce(columns[i], *[_taken(columns[(i + j) % fuzzy.bins]) for j in range(1, min(4, fuzzy.bins))], _taken(_next_full(columns, i))) for i in range(fuzzy.bins)]
    keys = [F.xxhash64(F.lit(b), *near[b * fuzzy.rows : (b + 1) * fuzzy.rows]) for b in range(fuzzy.bands)]
    return minima.select("h1", "h2", "times", (F.col("most") + 1).alias("size"), F.array(*keys).alias("bands"), ((empty * 4 > fuzzy.bins) & (F.col("most") >= fuzzy.spare * fuzzy.bins)).alias("poor"))


def _taken(minimum: Column) -> Column:
    """Another bin's minimum, told apart from the bin's own; a sum could leave the int."""
    return minimum.bitwiseXOR(F.lit(7919))


def _next_full(columns: list[Column], i: int) -> Column:
    return F.get(F.filter(F.array(*columns[i:], *columns[:i]), lambda x: x.isNotNull()), F.lit(0))


def _minima(lines: DataFrame, fuzzy: Fuzzy, thin: bool) -> DataFrame:
    """(h1, h2, times, most, m0, m1, ...): the smallest hash of the line's shingles in each bin; ``most`` is the last place of a shingle."""
    h = lines.select(*line_key(F.col("line")), F.encode("line", "UTF-16LE").alias("units")).withColumn("most", last_place(F.col("units"), fuzzy.shingle))
    h = h.select("h1", "h2", "units", "most", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("i"))
    h = h.select("h1", "h2", "most", "i", shingle_at(F.col("units"), F.col("i"), fuzzy.shingle).alias("h"))
    small = F.shiftrightunsigned("h", 40) * (F.col("most") + 1) < F.lit(fuzzy.spare * fuzzy.bins << 24)
    value = F.shiftrightunsigned("h", 33).cast("int")
    if thin:
        h = h.where(small | (F.col("i") == 0))
    own = small if thin else F.lit(True)
    h = h.select("h1", "h2", "most", "i", value.alias("value"), F.when(own, F.shiftright(F.col("h").bitwiseAND(F.lit(0xFFFFFF)) * fuzzy.bins, 24).cast("int")).otherwise(-1).alias("bin"))
    # filters, so that a shingle's row touches its own bin's minimum only
    minima = [F.expr(f"min(value) filter (where bin = {i})").alias(f"m{i}") for i in range(fuzzy.bins)]
    return h.groupBy("h1", "h2").agg(F.expr("count(*) filter (where i = 0)").alias("times"), F.expr("max(most) filter (where i = 0)").alias("most"), *minima)


def linked(groups: DataFrame, fuzzy: Fuzzy) -> DataFrame:
    """(band, low array, high array of (id, root, met, bands, line)) to edges (a, b) that connect the alike lines of each row.

    The sets of a row are made once, and only of lines that share the row with one they haven't met in an earlier band. Each line of ``high`` in turn is compared
    with the components found so far, in each until a line is alike, and joins those that hold one; at first the lines of ``low`` stand there by their roots. Lines of one root aren't compared, nor are those with equal ``met``, nor
    pairs that share an earlier band, where they meet as well. A row gives an edge a member at most, never its pairs.
    """
    units = lambda m: shingle_set(F.encode(m["line"], "UTF-16LE"), fuzzy.shingle)
    before = lambda side: F.transform(side, lambda m: F.struct(m["id"].alias("id"), m["root"].alias("root"), m["met"].alias("met"), F.slice(m["bands"], F.lit(1), F.col("band")).alias("before"), m["line"].alias("line")))
    new = lambda x, y: (x["root"] != y["root"]) & (x["met"] != y["met"]) & ~F.arrays_overlap(x["before"], y["before"])
    groups = groups.select(before("low").alias("low"), before("high").alias("high"))
    groups = groups.select(F.filter("low", lambda x: F.exists("high", lambda y: new(x, y))).alias("low"), F.filter("high", lambda x: F.exists("low", lambda y: new(x, y)) | F.exists("high", lambda y: new(x, y))).alias("high"))
    made = F.transform(F.concat("low", "high"), lambda m: F.struct(*(m[c].alias(c) for c in ("id", "root", "met", "before")), units(m).alias("set")))

    def alike(x: Column, y: Column) -> Column:
        n, m = F.size(x["set"]), F.size(y["set"])
        return (100 * F.least(n, m) >= fuzzy.percent * F.greatest(n, m)) & new(x, y) & ((100 + fuzzy.percent) * F.size(F.array_intersect(x["set"], y["set"])) >= fuzzy.percent * (n + m))

    def step(s: Column, found: Column, i: Column) -> Column:
        tried = F.transform(found, lambda c: F.struct(c.alias("c"), F.exists(c, lambda j: alike(F.get(s, i), F.get(s, j))).alias("hit")))
        those = lambda t, hit: F.transform(F.filter(t, lambda x: x["hit"] == hit), lambda x: x["c"])
        return F.get(F.transform(F.array(tried), lambda t: F.concat(those(t, False), F.array(F.flatten(F.concat(those(t, True), F.array(F.array(i))))))), F.lit(0))

    def found_in(s: Column, n: Column) -> Column:
        places = lambda a, b: F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i >= a) & (i < b))
        roots = F.array_distinct(F.transform(F.slice(s, F.lit(1), n), lambda x: x["root"]))
        start = F.transform(roots, lambda r: F.filter(places(0, n), lambda i: F.get(s, i)["root"] == r))
        return F.aggregate(places(n, F.size(s)), start, lambda found, i: step(s, found, i))

    def edges(s: Column, c: Column) -> Column:
        return F.transform(c, lambda i: F.struct(F.get(s, i)["id"].alias("a"), F.get(s, F.get(c, F.lit(0)))["id"].alias("b")))

    found = F.transform(F.array(made), lambda s: F.flatten(F.transform(found_in(s, F.size("low")), lambda c: edges(s, c))))
    return groups.select(F.inline(F.get(found, F.lit(0)))).where("a <> b").distinct()


def in_buckets(members: DataFrame, texts: DataFrame, fuzzy: Fuzzy) -> tuple[DataFrame, DataFrame]:
    """Edges inside all buckets (k, band, id, bands), and the buckets (k, m, units, parts) that one row doesn't hold.

    Of buckets with equal members only the one of the first band is taken. A larger bucket is dealt out to parts; each part also holds the bucket's
    first member, so that near copies become one component for about one comparison a member.
    """
    sums = members.groupBy("band", "k").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("m"), F.sum("size").alias("units"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("same"))
    once = sums.groupBy("a", "z", "m", "units", "same").agg(F.min(F.struct("band", "k"))["k"].alias("k"))
    parts = F.ceil(F.greatest(F.col("m") / fuzzy.block, F.col("units") / fuzzy.units)).cast("int")
    buckets = saved(once.select("k", "a", "m", "units", parts.alias("parts")))
    dealt = lookup(members, buckets, ["k"], "inner", NARROW)
    part = F.when(F.col("id") == F.col("a"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    rows = spread(dealt.select("k", "band", "id", "bands", F.explode(part).alias("part")).join(texts, "id"), "k", "part")
    rows = rows.groupBy("k", "part", "band").agg(F.array_sort(F.collect_list(F.struct("id", F.col("id").alias("root"), F.col("id").alias("met"), "bands", "line"))).alias("high")).where(F.size("high") > 1)
    nothing = F.array().cast("array<struct<id:long,root:long,met:long,bands:array<long>,line:string>>")
    return saved(linked(rows.select("band", nothing.alias("low"), "high"), fuzzy)), saved(buckets.where("parts > 1").select("k", "m", "units", "parts"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys to all shuffle partitions: rows are few and small, but costly, so that partitions mustn't be merged by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def across_parts(members: DataFrame, roots: DataFrame, large: DataFrame, texts: DataFrame, fuzzy: Fuzzy) -> DataFrame:
    """Edges between members of different components of the buckets that are too large for one row.

    The members outside a bucket's largest component meet all of its members, dealt out in blocks of both; those of one part have met before.
    """
    placed = lookup(lookup(members, large, ["k"], "inner", NARROW), roots.withColumnRenamed("v", "id"), ["id"], most=NARROW).withColumn("root", F.coalesce("root", "id"))
    placed = saved(placed)
    spans = placed.groupBy("k", "root").agg(F.count("*").alias("c"), F.sum("size").alias("u")).groupBy("k").agg(F.count("*").alias("roots"), F.max(F.struct("c", "u", "root")).alias("most")).where("roots > 1")
    parts = lambda c, u: F.greatest(F.lit(1), F.ceil(F.greatest(c / fuzzy.block, 2 * u / fuzzy.units)).cast("int"))
    spans = saved(lookup(spans, large, ["k"], "inner").select("k", F.col("most.root").alias("most"), parts(F.col("m"), F.col("units")).alias("all"), parts(F.col("m") - F.col("most.c"), F.col("units") - F.col("most.u")).alias("few")))
    rows = lookup(placed.withColumn("met", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("m", "units", "parts"), spans, ["k"], "inner")
    block, every = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = rows.where("root <> most").withColumn("i", block("few")).withColumn("j", every("all")).select("k", "band", "i", "j", "id", "root", "met", "bands", F.lit(True).alias("high"))
    y = rows.withColumn("j", block("all")).withColumn("i", every("few")).select("k", "band", "i", "j", "id", "root", "met", "bands", F.lit(False).alias("high"))
    met = spread(x.unionByName(y).join(texts, "id"), "k", "i", "j").groupBy("k", "band", "i", "j")
    side = lambda high: F.array_sort(F.collect_list(F.when(F.col("high") == high, F.struct("id", "root", "met", "bands", "line"))))
    both = met.agg(side(False).alias("low"), side(True).alias("high")).where((F.size("low") > 0) & (F.size("high") > 0))
    return saved(linked(both, fuzzy))


def repeated_lines(docs: DataFrame, fuzzy: Fuzzy = Fuzzy(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places (doc_id, th, pos) of the lines to remove: of a component of alike lines only the first (smallest doc_id, then th, then pos) stays.

    Lines lie between line feeds; blank ones are never removed. A null doc_id comes first. th is a hash of the text: rows equal in both
    are one document (their lines stay or go together); a null text has no lines; an empty table gives an empty result.

    The members of a bucket (band, key) are compared inside one row, on full sets, until those alike are one component. Buckets that are too large for a row are
    dealt out to parts that share one member; where they still span components, the members outside the largest one then meet all others in blocks.
    So no alike pair that shares a bucket is missed, and no pairs are written.
    """
    lines = lines_of(docs, doc_id, text)
    distinct = sketch_lines(lines, fuzzy)
    buckets = distinct.select("id", "size", "bands", F.posexplode("bands").alias("band", "k"))
    shared = saved(buckets.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"))
    members = saved(lookup(buckets, shared, ["k"], "inner", NARROW))
    wanted = members.select("id").distinct().withColumn("met", F.lit(True))
    keys = saved(distinct.join(wanted, "id", "left").where("met or times > 1").select("id", "h1", "h2", "met"))
    keyed = lines.select("doc_id", "th", "pos", "line", *line_key(F.col("line")))
    own = saved(lookup(keyed, keys, ["h1", "h2"], "inner", NARROW).select("id", "doc_id", "th", "pos", F.when(F.col("met"), F.col("line")).alias("line")))
    texts = saved(own.where("line is not null").groupBy("id").agg(F.first("line").alias("line")))
    links, large = in_buckets(members, texts, fuzzy)
    roots = saved(components(links))
    if not large.isEmpty():
        more = across_parts(members, roots, large, texts, fuzzy)
        if not more.isEmpty():
            roots = saved(components(links.union(more)))
    own = lookup(own.select("id", "doc_id", "th", "pos"), roots.withColumnRenamed("v", "id"), ["id"], most=NARROW).withColumn("group", F.coalesce("root", "id"))
    place = F.struct("doc_id", "th", "pos")
    firsts = saved(own.groupBy("group").agg(F.min(place).alias("keep")))
    return own.join(firsts, "group").where(~place.eqNullSafe(F.col("keep"))).select("doc_id", "th", "pos")


def drop_repeated_lines(docs: DataFrame, fuzzy: Fuzzy = Fuzzy(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines cut out of the texts; columns stay as they are."""
    gone = saved(_by_document(repeated_lines(docs, fuzzy, doc_id, text)))
    d = lookup(docs.withColumns({"__d": F.col(doc_id), "__th": F.xxhash64(text)}), gone.select(F.col("doc_id").alias("__d"), F.col("th").alias("__th"), F.col("gone").alias("__gone")), ["__d", "__th"], most=20_000)
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains("__gone", i))
    return d.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def _by_document(places: DataFrame) -> DataFrame:
    return places.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def op10_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of all documents: how many there are, how many go, and which (places from 0, comma-joined)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = saved(_by_document(repeated_lines(docs)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    some = lookup(rows, gone, ["doc_id", "th"], most=20_000)
    return some.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.transform("gone", lambda i: i.cast("string")), ","), F.lit("")).alias("removed_lines"))
