"""Action plans as JSON, and formats for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .text import let, strip

PLAN = (
    "inScope boolean, summary string, findings array<struct<text:string,refs:array<string>>>, causes array<struct<text:string,confidence:string,refs:array<string>>>, "
    "actions array<struct<text:string,priority:string,owner:string,refs:array<string>>>, dataToConfirm array<string>"
)
EMPTY = "array<string>"


def unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def parse_plan(raw: Column) -> Column:
    """The plan, or null if it is no JSON or breaks a rule: lists of at most 6 (causes 5), known levels, and findings and actions if in scope."""
    plan = F.when(F.try_parse_json(unfenced(raw)).isNotNull(), F.from_json(unfenced(raw), PLAN))

    def valid(p):
        have = F.coalesce(p["inScope"].isNotNull() & p["summary"].isNotNull() & p["findings"].isNotNull() & p["causes"].isNotNull() & p["actions"].isNotNull() & p["dataToConfirm"].isNotNull(), F.lit(False))
        small = (F.size(p["findings"]) <= 6) & (F.size(p["causes"]) <= 5) & (F.size(p["actions"]) <= 6) & (F.size(p["dataToConfirm"]) <= 6)
        levels = F.forall(p["causes"], lambda c: F.coalesce(c["confidence"].isin("high", "medium", "low"), F.lit(False))) & F.forall(p["actions"], lambda a: F.coalesce(a["priority"].isin("P0", "P1", "P2"), F.lit(False)))
        filled = ~p["inScope"] | ((F.size(p["findings"]) > 0) & (F.size(p["actions"]) > 0))
        return F.when(have & small & levels & filled, p)

    return let(plan, valid)


def plan_refs(plan: Column) -> Column:
    """Distinct references of findings, causes and actions, in order."""
    own = lambda a: F.flatten(F.transform(a, lambda x: F.coalesce(x["refs"], F.array().cast(EMPTY))))
    every = F.concat(own(plan["findings"]), own(plan["causes"]), own(plan["actions"]))
    return F.array_distinct(F.filter(F.transform(every, lambda r: strip(r)), lambda r: r != ""))


def ungrounded_refs(plan: Column, sources: Column) -> Column:
    return F.filter(plan_refs(plan), lambda r: ~F.contains(sources, r))


def render_plan(plan: Column, titles: tuple[str, str, str, str] = ("Findings", "Likely causes", "Actions", "Data to confirm")) -> Column:
    """Markdown of a plan; only the summary if it is out of scope."""
    cited = lambda x: F.when(F.size(F.coalesce(x["refs"], F.array().cast(EMPTY))) > 0, F.concat(x["text"], F.lit(" ("), F.array_join(x["refs"], ", "), F.lit(")"))).otherwise(x["text"])
    owner = lambda x: F.when(F.coalesce(x["owner"], F.lit("")) != "", F.concat(F.lit(" — "), x["owner"])).otherwise("")
    parts = [F.array(plan["summary"], F.lit(""), F.lit(f"## {titles[0]}")), F.transform(plan["findings"], lambda x: F.concat(F.lit("- "), cited(x)))]
    parts += [F.array(F.lit(""), F.lit(f"## {titles[1]}")), F.transform(plan["causes"], lambda x: F.concat(F.lit("- ["), x["confidence"], F.lit("] "), cited(x)))]
    parts += [F.array(F.lit(""), F.lit(f"## {titles[2]}")), F.transform(plan["actions"], lambda x: F.concat(F.lit("- "), x["priority"], F.lit(" · "), cited(x), owner(x)))]
    parts += [F.array(F.lit(""), F.lit(f"## {titles[3]}")), F.transform(plan["dataToConfirm"], lambda x: F.concat(F.lit("- "), x))]
    return F.when(~plan["inScope"], plan["summary"]).otherwise(F.array_join(F.concat(*parts), "\n"))


def format_usd(x: Column) -> Column:
    fixed = lambda n: F.concat(F.lit("$"), F.format_string(f"%.{n}f", x))
    return F.when(x.isNull(), "—").when(x == 0, "$0").when(x < 0.0001, "<$0.0001").when(x < 0.01, fixed(4)).when(x < 1, fixed(3)).otherwise(fixed(2))


def format_tokens(n: Column) -> Column:
    return F.when(n.isNull(), "—").when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(n >= 10_000, F.concat(F.format_string("%.1f", n / 1000), F.lit("k"))).otherwise(F.format_number(n, 0))


def embed_prompt(model: Column, purpose: Column, text: Column, title: Column) -> Column:
    """What a vector model is given; a blank title counts as none."""
    named = F.coalesce(title, F.lit("")) != ""
    plain = F.when(named, F.concat(title, F.lit("\n"), text)).otherwise(text)
    doc = F.concat(F.lit("title: "), F.when(named, title).otherwise("none"), F.lit(" | text: "), text)
    return F.when(~model.startswith("embeddinggemma"), plain).when(purpose == "document", doc).when(purpose == "query", F.concat(F.lit("task: search result | query: "), text)).otherwise(F.concat(F.lit("task: sentence similarity | query: "), text))


def compact_table(rows: Column, columns: tuple[str, ...]) -> Column:
    """An array of structs as text: columns that never change once above, the others in lines; bars are escaped."""
    cell = lambda v: F.regexp_replace(F.coalesce(v.cast("string"), F.lit("-")), r"\|", r"\\|")

    def text(rs):
        first = F.get(rs, F.lit(0))
        same = {c: (F.size(rs) > 1) & F.forall(rs, _equal(first, c)) for c in columns}
        above = F.array_compact(F.array(*[F.when(same[c], F.concat(F.lit(f"{c}="), first[c].cast("string"))) for c in columns]))
        head = F.array_compact(F.array(*[F.when(~same[c], F.lit(c)) for c in columns]))
        line = lambda r: F.array_join(F.array_compact(F.array(*[F.when(~same[c], cell(r[c])) for c in columns])), " | ")
        lines = F.concat(F.when(F.size(above) > 0, F.array(F.concat(F.lit("same for all rows: "), F.array_join(above, "; ")))).otherwise(F.array().cast(EMPTY)), F.when(F.size(head) > 0, F.concat(F.array(F.array_join(head, " | ")), F.transform(rs, line))).otherwise(F.array().cast(EMPTY)))
        return F.when(F.size(rs) == 0, "(none)").otherwise(F.array_join(lines, "\n"))

    return let(rows, text)


def told_once(results: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """run_id, result_pos, text of each result of a run: rows that an earlier result of the run showed are only named by their ids.

    ``results``: run_id, result_pos, row_pos, row (a struct with ``id``). Rows without an id are always shown. The first
    place of a row is a window over its run and digest, so what a run has shown is never held in one place. Rows are dealt
    twice: by run and digest, and as they are by run and result.
    """
    # 128 bits of it, as bytes: what is dealt for each row
    digest = F.unhex(F.substring(F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256), 1, 32))
    named = F.col("row")["id"].isNotNull()
    first = F.min("result_pos").over(Window.partitionBy("run_id", "_digest"))
    keyed = results.where(named).withColumn("_digest", digest).withColumn("_fresh", F.coalesce(first == F.col("result_pos"), F.lit(True))).drop("_digest")
    shown = keyed.unionByName(results.where(~named).withColumn("_fresh", F.lit(True))).repartition("run_id", "result_pos")
    rows = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("row_pos", "row")))), lambda x: x["row"])
    held = shown.groupBy("run_id", "result_pos").agg(rows(F.col("_fresh")).alias("fresh"), rows(~F.col("_fresh")).alias("seen"))
    also = F.concat(F.lit("also: "), F.array_join(F.transform("seen", lambda r: r["id"].cast("string")), ", "), F.lit(" (listed above)"))
    text = F.concat_ws("\n", F.when(F.size("fresh") > 0, compact_table(F.col("fresh"), columns)), F.when(F.size("seen") > 0, also))
    return held.select("run_id", "result_pos", text.alias("text"))


# What makes a reply a claim about data, and how short a direct reply is.
DATA_CLAIM = r"(?<![A-Za-z0-9_])B-\d{6}-\d{2}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])T-[A-Z]+-\d+(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])[A-Z]{2,}(?:-[A-Z0-9]{2,})+(?![A-Za-z0-9_])|\d(?:\.\d+)?\s*%"
DIRECT_CHARS = {"zh": 200, "en": 600}


def missing_sections(text: Column, titles: tuple[str, ...], least: int = 200) -> Column:
    """The titles that a text of at least ``least`` characters lacks, in any case."""
    low = F.lower(text)
    lacking = F.filter(F.array(*map(F.lit, titles)), lambda t: ~F.contains(low, F.lower(t)))
    return F.when(F.length(strip(text)) >= least, lacking).otherwise(F.array().cast(EMPTY))


def is_direct_reply(text: Column, language: Column, titles: tuple[str, ...]) -> Column:
    """Short, without claims about data, and with fewer than two titles of a plan."""
    most = F.when(language == "en", DIRECT_CHARS["en"]).otherwise(DIRECT_CHARS["zh"])
    low = F.lower(text)
    held = F.size(F.filter(F.array(*map(F.lit, titles)), lambda t: F.contains(low, F.lower(t))))
    return (F.coalesce(F.length(text), F.lit(0)) > 0) & (F.length(text) < most) & ~text.rlike(DATA_CLAIM) & (held < 2)


def _equal(first: Column, name: str):
    return lambda r: r[name].eqNullSafe(first[name])
