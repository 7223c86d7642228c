"""URL filter: rules first, then a tree of path templates for each host. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, keyed_join, stage_table, table

#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Segments of a path that the tree tells apart; what is deeper is one wildcard.
DEPTH = 4
#: A segment becomes a wildcard where its place holds more distinct values than this.
VARIETY = 12
#: Strength and value of the prior of a purity, the purity from which a template is rejected, and the z below which branches are alike.
STRENGTH, PRIOR, REJECT, ALIKE = 4.0, 0.1, 0.6, 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: host up to / ? # with A-Z lower-cased, path from there up to ? or #; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, nulls where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in ordered]
    pick = lambda values: reduce(lambda rest, pair: F.when(pair[0], F.lit(pair[1])).otherwise(rest), reversed(list(zip(fits, values, strict=True))), F.lit(None).cast("string"))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def raw_template(path: Column) -> Column:
    """Segments of a path, up to DEPTH and one for what is deeper, those that vary by their looks replaced by a wildcard."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    shaped = F.transform(
        parts,
        lambda s: F.when(F.regexp_like(s, F.lit(r"^[0-9]+$")), F.lit("*"))
        .when(F.regexp_like(s, F.lit(r"^[0-9]+\.[A-Za-z0-9]+$")), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z0-9]+)$", 1)))
        .when(F.regexp_like(s, F.lit(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$")), F.lit("*"))
        .when(F.length(s) > 64, F.lit("*"))
        .otherwise(s),
    )
    return F.when(F.size(shaped) > DEPTH, F.concat(F.slice(shaped, 1, DEPTH), F.array(F.lit("**")))).otherwise(shaped)


def _purity(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + F.lit(STRENGTH) * prior) / (labelled + F.lit(STRENGTH))


def _merged(above: Column, node: Column) -> Column:
    """What stands at a node: the labels above it where the blocked shares don't differ by a z test, else its own."""
    share = lambda blocked, labelled: blocked / F.greatest(labelled, F.lit(1))
    lab, blk = node["nlab"].cast("double"), node["nblk"].cast("double")
    pooled = share(above["blk"] + blk, above["lab"] + lab)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(above["lab"], F.lit(1.0)) + 1 / F.greatest(lab, F.lit(1.0))))
    alike = (above["lab"] > 0) & (lab > 0) & (F.abs(share(blk, lab) - share(above["blk"], above["lab"])) <= F.lit(ALIKE) * spread + F.lit(1e-12))
    return F.when(alike, above).otherwise(F.struct(lab.alias("lab"), blk.alias("blk")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, raw, n, template, purity) of every raw template and its n pages; ``pages`` has host, raw and label (1 blocked, 0 allowed, null).

    Only the first aggregate reads pages; it is combined before its shuffle, so a host with a third of them is a few
    rows for each task. Everything after it works on distinct raw templates. Each level of the tree is written before the
    next is planned, so plans stay small and a lost executor costs one level.
    """
    spark = pages.sparkSession
    tree, path = stage_table(pages.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blk")).withColumn("template", F.col("raw")), "url-tree")
    total = tree.count()
    for depth in range(1, DEPTH + 1):
        deep = F.size("template") >= depth
        # Shorter templates have no node here: each gets a key that no segment can be, so that they stay spread.
        placed = tree.withColumn("prefix", F.when(deep, F.slice("template", 1, depth - 1)).otherwise(F.array(F.concat(F.lit("/"), F.xxhash64("raw").cast("string")))))
        kinds = placed.filter(deep).groupBy("host", "prefix", F.element_at("template", depth).alias("seg")).agg(F.count("*").alias("raws"))
        wide = kinds.groupBy("host", "prefix").agg(F.count("*").alias("kinds"), F.sum("raws").alias("raws")).filter(F.col("kinds") > VARIETY).select("host", "prefix", "raws", F.lit(True).alias("wide"))
        met = keyed_join(placed, wide, ["host", "prefix"], "raws", total, F.xxhash64("raw"))
        template = F.when(F.col("wide"), F.concat(F.slice("template", 1, depth - 1), F.array(F.lit("*")), F.slice("template", depth + 1, DEPTH + 1))).otherwise(F.col("template"))
        following, next_path = stage_table(met.select("host", "raw", "n", "lab", "blk", template.alias("template")), "url-tree")
        delete_path(spark, path)
        tree, path = following, next_path
    leaves, leaves_path = stage_table(tree.groupBy("host", "template").agg(F.count("*").alias("raws"), F.sum("lab").alias("lab"), F.sum("blk").alias("blk")), "url-leaves")
    # Every node above a leaf, the root included, with the labels below it. A host has a bounded number of leaves: VARIETY + 1 branches a level.
    up = leaves.select("host", "template", "raws", "lab", "blk", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("depth")).withColumn("prefix", F.slice("template", F.lit(1), F.col("depth")))
    nodes = up.groupBy("host", "prefix").agg(F.sum("lab").alias("nlab"), F.sum("blk").alias("nblk"))
    chains = up.select("host", "template", "raws", "prefix", "depth").join(nodes, ["host", "prefix"]).groupBy("host", "template", "raws").agg(F.array_sort(F.collect_list(F.struct("depth", "nlab", "nblk"))).alias("chain"))
    # From the root down: a branch like what stands above it is merged with it; an unlabelled one keeps to itself.
    start = F.struct(F.lit(0.0).alias("lab"), F.lit(0.0).alias("blk"))
    own, own_path = stage_table(chains.select("host", "template", "raws", F.aggregate("chain", start, _merged).alias("m")).withColumn("name", F.array_join("template", "/")), "url-own")
    # The same template on all hosts is the prior of a host's own.
    common = leaves.groupBy(F.array_join("template", "/").alias("name")).agg(F.count("*").alias("hosts"), F.sum("lab").alias("tlab"), F.sum("blk").alias("tblk"))
    prior = _purity(F.col("tblk"), F.col("tlab"), F.lit(PRIOR))
    met = keyed_join(own, common, ["name"], "hosts", own.count(), F.xxhash64("host"))
    scored = met.select("host", "template", "raws", F.round(_purity(F.col("m.blk"), F.col("m.lab"), prior), 9).alias("purity"))
    found, _ = stage_table(keyed_join(tree.select("host", "raw", "n", "template"), scored, ["host", "template"], "raws", total, F.xxhash64("raw")).select("host", "raw", "n", "template", "purity"), "url-templates")
    for done in (path, leaves_path, own_path):
        delete_path(spark, done)
    return found


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), a row a page.

    The longest rule that fits decides; the pages that rules decide are the labels from which the templates of the
    others get their purity. A null url, or one without ``://``, has the empty host and path, and a template like any other.
    Rows that repeat a page_id or a url are judged alike, each for itself; no other column is read, so none can clash; an empty
    table gives none. A very long path is matched whole by the rules and cut to DEPTH segments by the tree.
    """
    urls = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    parsed = urls.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    pages = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), raw_template(F.col("path")).alias("raw"))
    labelled = pages.select("host", "raw", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).alias("label"))
    found = templates(labelled)
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    judged = keyed_join(pages, found, ["host", "raw"], "n", total, F.col("page_id"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"))
