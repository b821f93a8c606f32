"""Sources: query plans, hits, page text, blocks, caches, result folders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.functions import words as W
from claimweave.session import read_if_there, shared_dir


def ordered_distinct(df: DataFrame, key: Column, order: list, by: list | None = None, kept: list | None = None) -> DataFrame:
    """One row per key (within by), the first in order: an aggregate, so it combines before the shuffle. kept: its columns, all without it."""
    kept = kept or df.columns
    groups = [F.col(c) if isinstance(c, str) else c for c in (by or [])]
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(f"`{c}`") for c in kept]))
    return df.groupBy(*[g.alias(f"_g{i}") for i, g in enumerate(groups)], key.alias("_key")).agg(first.alias("_first")).select(*[F.col(f"_first.`{c}`") for c in kept])


def query_plan(spark: SparkSession, target_a: str, target_b: str) -> DataFrame:
    """Side, kind, ord, query: search queries and focus phrases of two subjects, at most five of each kind."""
    a, b = (re.sub(r"\s+", " ", t).strip() for t in (target_a, target_b))
    rows = [("a", "target", i, q.format(a)) for i, q in enumerate(W.TARGET_QUERIES) if a] + [("b", "target", i, q.format(b)) for i, q in enumerate(W.TARGET_QUERIES) if b]
    rows += [("ab", "bridge", i, q.format(a=a, b=b)) for i, q in enumerate(W.BRIDGE_QUERIES) if a and b]
    for side, target in (("a", a), ("b", b)):
        terms = [t.lower() for t in re.findall(W.TOKEN, target) if len(t) > 2 and t.lower() not in W.STOP]
        focus = [target, *terms, *([" ".join(terms[:2]), " ".join(terms[-2:])] if len(terms) > 1 else [])]
        rows += [(side, "focus", i, f) for i, f in enumerate(focus) if f]
    plan = ordered_distinct(spark.createDataFrame(rows, "side string, kind string, ord int, query string"), F.lower("query"), [F.col("ord")], ["side", "kind"])
    rank = F.row_number().over(Window.partitionBy("side", "kind").orderBy("ord"))
    return plan.withColumn("_n", rank).where(F.col("_n") <= W.LIMITS["queries"]).drop("_n")


def work_list(plan: DataFrame) -> DataFrame:
    """The A, B and bridge queries as one list without repeats, in that order."""
    listed = plan.where("kind <> 'focus'").withColumn("place", F.struct(F.when(F.col("side") == "a", 0).when(F.col("side") == "b", 1).otherwise(2).alias("side"), "ord"))
    one = ordered_distinct(listed, F.lower("query"), [F.col("place")])
    return one.select((F.row_number().over(Window.orderBy("place")) - 1).alias("ord"), "query")


def merged_hits(*providers: DataFrame, limit: int = 16, offset: int = 0) -> DataFrame:
    """S3: hits (query, ord, title, url, snippet) of providers in turn: one per query and URL, one page of them."""
    all_ = reduce(DataFrame.unionByName, [p.withColumn("provider", F.lit(i)) for i, p in enumerate(providers)])
    one = ordered_distinct(all_, F.col("url"), [F.col("provider"), F.col("ord")], ["query"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy("provider", "ord", "url"))
    return one.withColumn("place", rank - 1).where(F.col("place").between(offset, offset + limit - 1))


#: Character references that are read.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags off, blanks squeezed."""
    t = F.regexp_replace(T.or_empty(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return decoded(F.regexp_replace(t, r"<[^>]+>", " "))


#: Parts of a page that hold no running text.
ASIDE = ["script", "style", "noscript", "svg", "nav", "header", "footer", "aside", "form", "table", "button", "select"]


def main_text(html: Column) -> Column:
    """A page's main text: what stands in its article or main element if it has one, without navigation, forms, tables and comments.

    Entities and blanks as in html_text. Nested elements of one kind end at the first end tag.
    """
    bare = F.regexp_replace(T.or_empty(html), r"(?s)<!--.*?-->", " ")
    for name in ASIDE:
        bare = F.regexp_replace(bare, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    inner = lambda name: F.regexp_extract(bare, rf"(?is)<{name}\b[^>]*>(.*)</{name}\s*>", 1)
    body = F.coalesce(*[F.when(inner(n) != "", inner(n)) for n in ("article", "main", "body")], bare)
    return html_text(body)


#: Elements that name the main text, and those that flow with it; what a tag costs beside the words that it parts.
NAMED = ["article", "main"]
INLINE = ["abbr", "b", "cite", "code", "em", "font", "i", "img", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "wbr"]
TAG_COST, LINK_COST, ASIDE_COST = 4, 6, 10
#: Removed with all they hold before a page is cut into tags and runs of text; these don't nest.
UNREAD = r"(?is)<!--.*?-->|<(?:script|style|noscript|svg|title)\b[^>]*>.*?</(?:script|style|noscript|svg|title)\s*>"
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9]*)"
#: Elements of ASIDE that can nest.
NESTING = [n for n in ASIDE if n not in ("script", "style", "noscript", "svg")]


def main_segments(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Key, text, segment of each page (key, html): its main text, nested elements and all.

    A page is a line of tags and runs of text. Running sums along it tell how deep a token stands in
    elements that hold no running text, which drop out, and in article or main, which is the text of
    a page that has one. segment is the stretch of greatest sum, where words count one each and tags cost:
    the text of a page that names none. Null and empty pages: empty. key: one row each.
    """
    runs = F.regexp_extract_all(F.regexp_replace(T.or_empty(F.col("html")), UNREAD, " "), F.lit("<[^>]*>|[^<]+"), F.lit(0))
    rows = pages.select(key, F.posexplode_outer(runs).alias("pos", "token")).withColumns({"pos": F.coalesce("pos", F.lit(0)), "token": T.or_empty(F.col("token"))})
    name = F.lower(F.regexp_extract("token", TAG_NAME, 1))
    rows = rows.withColumn("name", name).withColumn("turn", F.when(F.col("name") == "", 0).when(F.col("token").startswith("</"), -1).otherwise(1))
    line = Window.partitionBy(key).orderBy("pos")
    deep = lambda names: F.sum(F.when(F.col("name").isin(*names), F.col("turn")).otherwise(0)).over(line)
    rows = rows.withColumns({"aside": deep(NESTING), "named": deep(NAMED)})
    words = F.when((F.col("name") == "") & (F.col("aside") <= 0), F.regexp_count("token", F.lit(r"\S+"))).otherwise(0)
    cost = F.when(F.col("name").isin(*NESTING), ASIDE_COST).when(F.col("name") == "a", LINK_COST).when((F.col("name") == "") | F.col("name").isin(*INLINE), 0).otherwise(TAG_COST)
    shown = F.when(F.col("name") != "", F.when(F.col("name").isin("a", *INLINE), "").otherwise(" ")).when((F.col("aside") > 0) | F.col("token").startswith("<"), " ").otherwise(F.col("token"))
    rows = rows.withColumns({"words": words, "shown": shown}).withColumn("sum", F.sum(F.when(F.col("aside") > 0, F.lit(0)).otherwise(F.col("words")) - F.when((F.col("aside") > 0) & (F.col("turn") == 0), 0).otherwise(cost)).over(line))
    low = F.min(F.struct(F.col("sum").alias("s"), F.col("pos").alias("p"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_low", low).withColumn("_from", F.when(F.col("_low.s") < 0, F.col("_low.p") + 1).otherwise(0)).withColumn("_gain", F.col("sum") - F.least(F.coalesce("_low.s", F.lit(0)), F.lit(0)))
    whole = Window.partitionBy(key)
    best = F.max(F.struct(F.col("_gain").alias("g"), (-F.col("pos")).alias("p"), F.col("_from").alias("f"))).over(whole)
    rows = rows.withColumn("_best", best).withColumn("_in", F.col("pos").between(F.col("_best.f"), -F.col("_best.p")) & (F.col("_best.g") > 0))
    has = F.max(F.when((F.col("named") > 0) & (F.col("words") > 0), 1).otherwise(0)).over(whole)
    rows = rows.withColumn("_has", has)
    told = lambda kept: decoded(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "shown")))), lambda x: x["shown"]), ""))
    out = rows.groupBy(key).agg(told(F.col("named") > 0).alias("_named"), told(F.col("_in")).alias("segment"), F.max("_has").alias("_has"))
    return out.select(key, F.when(F.col("_has") == 1, F.col("_named")).otherwise(F.col("segment")).alias("text"), "segment")


def decoded(text: Column) -> Column:
    """A text with its character references read and blanks squeezed."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return T.squeezed(text)


def clean_url(url: Column) -> Column:
    """A URL without quotes and brackets, '' unless it is http(s) with a host."""
    bare = F.btrim(F.trim(T.or_empty(url)), F.lit("\"'<>[]()"))
    return F.when(bare.rlike(r"^https?://[^/?#]+"), bare).otherwise("")


def source_tag(title: Column, url: Column) -> Column:
    """S6: 'title|url', or what there is of it, or 'unknown'."""
    t, u = T.clean_part(title), clean_url(url)
    return F.when((t != "") & (u != ""), F.concat_ws("|", t, u)).when(u != "", u).when(t != "", t).otherwise("unknown")


def hit_blocks(hits: DataFrame, prefer_snippets: bool = False) -> DataFrame:
    """Query, ord, url, source, content: page text of 80 characters or more, else the snippet; at most 2400."""
    long_, most = W.LIMITS["min_block_chars"], W.LIMITS["max_block_chars"]
    page, snippet = T.squeezed(F.col("page_text")), T.squeezed(F.col("snippet"))
    choices = [F.when(F.length(c) >= long_, F.substring(c, 1, most)) for c in ([snippet, page] if prefer_snippets else [page, snippet])]
    content = F.coalesce(*choices, F.substring(snippet, 1, most))
    made = hits.select("query", "ord", clean_url(F.col("url")).alias("url"), source_tag(F.col("title"), F.col("url")).alias("source"), content.alias("content")).where("content <> ''")
    one = ordered_distinct(made, F.sha2(F.concat_ws("\u0000", "url", F.substring("content", 1, 512)), 256), [F.col("ord"), F.col("url")], ["query"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy("ord", "url"))
    return one.withColumn("_n", rank).where(F.col("_n") <= W.LIMITS["blocks"]).drop("_n")


def limited_blocks(blocks: DataFrame, most: int = W.LIMITS["max_block_chars"]) -> DataFrame:
    """Blocks cut into successive ones of at most most characters, at blanks where there are any: ord counts on within a block."""
    cut = F.regexp_extract_all(F.col("content"), F.lit(rf"(?s)\S.{{0,{most - 2}}}\S(?=\s|$)|\S{{1,{most}}}"), F.lit(0))
    return blocks.select("block_id", F.col("ord").alias("_ord"), "url", "source", F.posexplode(cut).alias("_part", "content")).select("block_id", (F.col("_ord") * 100_000 + F.col("_part")).alias("ord"), "url", "source", "content")


def document_blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks: block_id, ord, url, source, content."""
    return docs.select(F.col("doc_id").alias("block_id"), F.col("doc_id").alias("ord"), F.lit("").alias("url"), F.concat_ws("|", F.col("source"), F.concat(F.lit("doc="), F.col("doc_id"))).alias("source"), T.or_empty(F.col("text")).alias("content"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Pages as blocks of at most 2400 characters of their text."""
    return pages.select(F.col("page_id").alias("block_id"), F.col("page_id").alias("ord"), clean_url(F.col("url")).alias("url"), source_tag(F.lit(""), F.col("url")).alias("source"), F.substring(html_text(F.col("html")), 1, W.LIMITS["max_block_chars"]).alias("content"))


def distinct_blocks(blocks: DataFrame, cleaned: bool = False) -> DataFrame:
    """A10: blocks with text, one per URL and content, or per source and content where there is no URL. cleaned: with their cleaned text as content.

    A text is cleaned once: a filter on what cleaning leaves would do so again, and before the blocks are dealt out.
    """
    content = F.col("_clean")
    rows = blocks.select("*", F.explode(F.filter(F.array(T.clean(F.col("content"))), lambda c: c != "")).alias("_clean"))
    if cleaned:
        rows = rows.withColumn("content", content)
    key = F.when(F.col("url") != "", F.struct(F.col("url").alias("a"), F.sha2(content, 256).alias("b"))).otherwise(F.struct(F.lit("").alias("a"), F.sha2(F.concat(F.col("source"), F.lit("\u0000"), content), 256).alias("b")))
    return ordered_distinct(rows, key, [F.col("ord")], kept=blocks.columns)


def cached(spark: SparkSession, rows: DataFrame, key: Column, make, name: str) -> DataFrame:
    """Rows already in the named cache table are read, the others made and added to it.

    make takes rows (with cache_key) and returns rows with cache_key. The table is Parquet in the
    shared folder, and each call adds its own part.
    """
    path = f"{shared_dir(spark)}/cache-{name}"
    keyed = rows.withColumn("cache_key", F.sha2(key, 256))
    known = read_if_there(spark, path)
    missing = keyed if known is None else keyed.join(known.select("cache_key").distinct(), "cache_key", "left_anti")
    make(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(keyed.select("cache_key").distinct(), "cache_key", "left_semi")


def write_results(report: str, edges: DataFrame, arguments: DataFrame, path: str, targets: tuple[str, str] | None = None, pairs: DataFrame | None = None, walks: DataFrame | None = None) -> str:
    """A result folder: synthesis, connections and arguments as text, Spark's writers throughout.

    targets are kept beside the arguments, by which read_results tells them (S17). pairs and walks (S14): diagnostics of
    the argument, the pairs of anchors that were and weren't chosen, and what became of the walks.
    """
    spark = edges.sparkSession
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.text(f"{path}/synthesis")
    edges.select(F.format_string("%s | %s | %s [%s] utility=%.4f", "s", "rel", "o", "source", "utility").alias("value")).write.text(f"{path}/connections")
    arguments.select(F.to_json(F.struct(*arguments.columns)).alias("value")).write.text(f"{path}/arguments")
    if targets:
        spark.createDataFrame([targets], "target_a string, target_b string").coalesce(1).write.json(f"{path}/targets")
    if pairs is not None:
        said = F.format_string("%s%s <-> %s rank=%s", F.when(F.col("selected"), "* ").otherwise("  "), "a", "b", F.to_json("rank"))
        pairs.orderBy("place").select(said.alias("value")).coalesce(1).write.text(f"{path}/pairs")  # twelve rows at most
    if walks is not None:
        walks.groupBy("seed", "goal", "reason").agg(F.count("*").alias("n"), F.round(F.avg(F.size("path")), 2).alias("nodes")).select(F.to_json(F.struct("seed", "goal", "reason", "n", "nodes")).alias("value")).write.text(f"{path}/walks")
    return path


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Name, report, target_a, target_b (null where they weren't kept) of the result folders below root, newest name first."""
    if ".." in root.split("/"):
        raise ValueError("a result folder may not climb out of its root")
    named = lambda part: F.regexp_extract(F.input_file_name(), rf"/([^/]+)/{part}/", 1).alias("name")
    read = spark.read.text(f"{root}/*/synthesis", wholetext=True).select(named("synthesis"), F.col("value").alias("report")).where("report <> ''")
    try:
        told = spark.read.schema("target_a string, target_b string").json(f"{root}/*/targets").select(named("targets"), "target_a", "target_b")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        told = spark.createDataFrame([], "name string, target_a string, target_b string")
    return read.join(told, "name", "left").orderBy(F.desc("name"))


def command(data: Column) -> Column:
    """struct<id, target_a, target_b> from a JSON command or 'a|b'."""
    parsed = F.from_json(data, "id string, target_a string, target_b string")
    parts = F.split(T.or_empty(data), r"\|")
    legacy = F.struct(F.lit(None).cast("string").alias("id"), F.trim(parts[0]).alias("target_a"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("target_b"))
    return F.when(F.trim(data).startswith("{"), parsed).otherwise(legacy)


def check_command(target_a: str, target_b: str, limit: int = 2048) -> None:
    """Both targets are required and the command is at most 2 KiB."""
    if not target_a.strip() or not target_b.strip():
        raise ValueError("both subjects are required")
    if len((target_a + target_b).encode()) > limit:
        raise ValueError(f"a command holds at most {limit} bytes")


