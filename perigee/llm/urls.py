"""URL filters: block and allow rules, and for all other addresses a tree of path templates per host.

The tree: a page's path is cut at slashes (a last piece keeps its extension as a shape of its own); from the root on,
a piece becomes the wildcard * where it is variable: it has digits, is long, or is one of many pieces (more than
`max_children`) of its parent, none of which stands for a fair share of the parent's pages. The tree is as deep as the
paths are. Fixed pieces of a parent stay, unless they are statistically similar: siblings that differ in one fixed piece
alone, each with at least `least` labelled pages, stand in the order of their smoothed shares of bad pages, and those
between whose shares a test of two proportions sees no difference (`z` standard errors) merge into one branch, named
(a|b). Each branch then has labelled pages, good and bad; its purity is smoothed towards that of its first piece, that
towards its host's and that towards the corpus's, each prior counting as `strength` pages. A branch is rejected if its
smoothed share of bad pages exceeds `reject`. Pages without labels take their branch's verdict.

Only DataFrame expressions are used; every count is a partially aggregated group-by and is written before rows are
joined with it, so the rows of a host with a third of all pages can be split. The walk down the tree takes a step for
each level at which some parent still has more than `max_children` paths below it: below any other parent nothing can
become a wildcard by number, so its paths are done at once, and pieces that all paths of a parent share are one step.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and takes the verdict of the
empty host's tree; repeated rows are judged alike; a null page_id is passed through; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm.common import materialize

def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, its A-Z lower-cased, and the path, up to query and fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null where none does; of equally long ones the first in order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, below = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + below))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _variable(piece: Column) -> Column:
    """Whether a piece alone shows that it varies: digits, or very long."""
    return piece.rlike("[0-9]") | (F.length(piece) > 40)


def _shaped(piece: Column) -> Column:
    """The wildcard for a variable piece, with the extension that it keeps."""
    return F.concat(F.lit("*"), F.regexp_extract(piece, r"(\.[A-Za-z]{1,5})\z", 1))


def templates(pages: DataFrame, max_children: int = 24, share: float = 0.02) -> DataFrame:
    """(host, path, template) for every distinct (host, path) of pages, which has the columns host, path, n.

    The children of each (host, template so far) are counted, and those that vary become wildcards.
    """
    parts = F.transform(F.split(F.substr("path", F.lit(2)), "/"), lambda p: F.when(_variable(p), _shaped(p)).otherwise(p))
    rows = pages.groupBy("host", "path").agg(F.sum("n").alias("n")).withColumn("rest", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(parts))
    rows = materialize(rows.withColumn("template", F.lit("")))
    done, active = [rows.where("size(rest) = 0")], rows.where("size(rest) > 0")
    while True:
        parents = materialize(active.groupBy("host", "template").agg(F.count("*").alias("paths"), F.sum("n").alias("of"), F.min("rest").alias("low"), F.max("rest").alias("high")))
        if parents.isEmpty():
            break
        # What the first and the last of a parent's paths share, all of them do.
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a != b, F.lit(True))), F.lit(True)).cast("int")
        shared = F.when(differ == 0, F.size("low")).otherwise(differ - 1)
        parents = parents.select(F.col("host").alias("h"), F.col("template").alias("t"), "paths", "of", shared.alias("shared"))
        piece = F.get("rest", F.lit(0))
        child = active.groupBy("host", "template", piece.alias("piece")).agg(F.sum("n").alias("m"))
        sizes = child.groupBy("host", "template").agg(F.count("*").alias("children")).where(F.col("children") > max_children)
        sizes = materialize(sizes.select(F.col("host").alias("h"), F.col("template").alias("t"), "children").join(parents, ["h", "t"]).select("h", "t", "of"))
        many = child.join(sizes, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))).where((F.col("m") < share * F.col("of")) & ~F.startswith("piece", F.lit("*")))
        many = materialize(many.select(F.col("h").alias("mh"), F.col("t").alias("mt"), F.col("piece").alias("mp")))
        step = active.join(parents, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")))
        step = step.join(many, (F.col("host") == F.col("mh")) & (F.col("template") == F.col("mt")) & (piece == F.col("mp")), "left")
        # Few paths: all the rest. A shared beginning: all of it. Else one piece.
        taken = F.when(F.col("paths") <= max_children, F.size("rest")).otherwise(F.greatest("shared", F.lit(1)))
        own = F.when(F.col("mp").isNotNull(), F.array(_shaped(piece))).otherwise(F.slice("rest", F.lit(1), taken))
        rest = F.slice("rest", F.when(F.col("mp").isNotNull(), 1).otherwise(taken) + 1, F.size("rest"))
        step = materialize(step.select("host", "path", "n", rest.alias("rest"), F.concat("template", F.lit("/"), F.array_join(own, "/")).alias("template")))
        done.append(step.where("size(rest) = 0"))
        active = step.where("size(rest) > 0")
    return materialize(reduce(DataFrame.unionByName, done).select("host", "path", "template"))


def merged(leaves: DataFrame, z: float, least: int, strength: float) -> DataFrame:
    """(host, template, branch) of leaves (host, template, known, bad, host_share): similar siblings share a branch.

    Place by place from the first on, wherever any siblings differ in that place alone. A parent has at most some dozens
    of fixed pieces (others are wildcards by now), so a family of siblings is small.
    """
    names = materialize(leaves.withColumn("branch", F.col("template")))
    pieces = F.split(F.substr("branch", F.lit(2)), "/")
    masked = lambda k: F.array_join(F.transform("pieces", lambda p, i: F.when(i == k, F.lit("*")).otherwise(p)), "/")
    able = names.where(F.col("known") >= least).withColumn("pieces", pieces)
    places = able.select("host", "pieces", F.posexplode("pieces").alias("k", "piece")).where(~F.startswith("piece", F.lit("*")))
    places = places.groupBy("host", "k", masked(F.col("k")).alias("family")).agg(F.count("*").alias("n")).where("n > 1").select("k").distinct()
    for k in sorted(r["k"] for r in places.collect()):  # places in a path
        now = names.groupBy("host", "branch").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"), F.first("host_share").alias("host_share"))
        now = now.where(F.col("known") >= least).withColumn("pieces", pieces).withColumn("piece", F.get("pieces", F.lit(k))).where(F.col("piece").isNotNull() & ~F.startswith("piece", F.lit("*")))
        p = smoothed(F.col("bad"), F.col("known"), F.col("host_share"), strength)
        now = now.withColumn("family", masked(F.lit(k))).withColumn("p", p).withColumn("v", F.col("p") * (1 - F.col("p")) / (F.col("known") + strength))
        w = Window.partitionBy("host", "family").orderBy("p", "piece")
        apart = F.col("p") - F.lag("p").over(w) > z * F.sqrt(F.col("v") + F.lag("v").over(w))
        now = now.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("run", F.sum("apart").over(w))
        runs = now.groupBy("host", "family", "run").agg(F.collect_list("branch").alias("from"), F.array_join(F.array_sort(F.collect_list("piece")), "|").alias("all"), F.first("pieces").alias("pieces")).where("size(from) > 1")
        whole = F.transform("pieces", lambda p, i: F.when(i == k, F.concat(F.lit("("), F.col("all"), F.lit(")"))).otherwise(p))
        runs = materialize(runs.select(F.col("host").alias("h"), F.explode("from").alias("old"), F.concat(F.lit("/"), F.array_join(whole, "/")).alias("new")))
        names = names.join(runs, (F.col("host") == F.col("h")) & (F.col("branch") == F.col("old")), "left").withColumn("branch", F.coalesce("new", "branch")).drop("h", "old", "new")
        names = materialize(names)
    return names


def smoothed(bad: Column, n: Column, prior: Column, strength: float) -> Column:
    return (F.coalesce(bad, F.lit(0)) + strength * prior) / (F.coalesce(n, F.lit(0)) + strength)


def judged(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, strength: float = 4.0, reject: float = 0.5, least: int = 5, z: float = 1.96) -> DataFrame:
    """(id, host, path, rule, verdict, template, bad_share) of every row of pages.

    labels: (id, bad 0/1) of some pages; without it, what the rules decide labels the pages that they fit: a path
    template whose labelled pages are mostly blocked is rejected for the pages that no rule fits.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("decided"))
    if labels is None:
        rows = rows.withColumn("bad", (F.col("decided") == "block").cast("int"))
    else:
        own = labels.select(F.col("id").alias("_of"), F.col("bad").cast("int").alias("bad")).where("bad in (0, 1)").groupBy("_of").agg(F.max("bad").alias("bad"))
        rows = rows.join(own, F.col("id") == F.col("_of"), "left").drop("_of")
    # Everything below works on one row for each address without query and fragment.
    rows = materialize(rows)
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    paths = materialize(paths)
    named = templates(paths)
    tree = materialize(paths.join(named, ["host", "path"]))

    total = tree.agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).first()
    corpus = F.lit((total["bad"] or 0) / ((total["known"] or 0) + 1))
    hosts = materialize(tree.groupBy("host").agg(F.sum("known").alias("host_known"), F.sum("bad").alias("host_bad")))
    leaves = materialize(tree.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))).join(hosts, "host")
    leaves = leaves.select("host", "template", "known", "bad", smoothed(F.col("host_bad"), F.col("host_known"), corpus, strength).alias("host_share"))
    leaves = merged(leaves, z, least, strength).withColumn("head", F.regexp_extract("branch", r"^(/[^/]*)?", 0))
    heads = materialize(leaves.groupBy("host", "head").agg(F.sum("known").alias("head_known"), F.sum("bad").alias("head_bad")))
    sums = materialize(leaves.groupBy("host", "branch").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")))
    leaves = leaves.select("host", "template", "branch", "head", "host_share").join(heads, ["host", "head"]).join(sums, ["host", "branch"])
    head_share = smoothed(F.col("head_bad"), F.col("head_known"), F.col("host_share"), strength)
    leaves = materialize(leaves.select("host", "template", "branch", "known", smoothed(F.col("bad"), F.col("known"), head_share, strength).alias("bad_share")))

    found = materialize(named.join(leaves, ["host", "template"]).select(F.col("host").alias("h"), F.col("path").alias("p"), "branch", "known", "bad_share"))
    out = rows.join(found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    method = F.when((F.col("known") >= least) & (F.col("bad_share") > reject), "block").otherwise("allow")
    return out.select("id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), F.col("branch").alias("template"), "bad_share")
