"""Small column functions: labels, dates, prices, JSON replies, nested records and request guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import text as tx
from .plans import unfenced

# Limits of requests and prompts.
MAX_INPUT, MAX_MESSAGES, MAX_HISTORY, PASSAGE_CHARS, LIMITS = 8000, 12, 16_000, 700, (1, 100)
# Similarity from which an answer is reused, and from which a section counts, by base model.
REUSE, REUSE_OTHER, FLOORS = {"embeddinggemma": 0.8, "gemini-embedding-001": 0.92}, 0.92, {"embeddinggemma": 0.45}
# Dollars for a million tokens of input and output.
PRICES = {
    "gemini-3.1-flash-lite": (0.25, 1.5),
    "gemini-3.8-flash": (0.75, 3.75),
    "gemini-3.7-flash": (0.75, 3.75),
    "gemini-3.6-flash": (0.75, 3.75),
    "gemini-3.5-flash": (1.5, 9.0),
    "gemini-3.5-flash-lite": (0.3, 2.5),
    "gemini-2.5-flash": (0.3, 2.5),
    "gemini-2.5-flash-lite": (0.1, 0.4),
}
DEFAULT_PRICE, EMBED_PRICE = (0.25, 1.5), 0.15
# Words that no offer may hold.
BANNED = ("上分", "代练", "代打", "排位上分", "(帮|代).{0,6}打排位", "账号共享", "借号", "租号", "账号密码", "要密码", "密码发给", "(?i:boost)", r"(?i:elo\s*boost)", r"(?i:rank\s*boost)", r"(?i:account\s*shar)")


def by_base(model: Column, table: dict, other) -> Column:
    """The value of the model's name up to the colon."""
    base = F.substring_index(model, ":", 1)
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(base == name, F.lit(value)).otherwise(out)
    return out


def reuse_threshold(model: Column, override: float | None = None) -> Column:
    return F.lit(override) if override is not None and 0 < override <= 1 else by_base(model, REUSE, REUSE_OTHER)


def similarity_floor(model: Column) -> Column:
    """Null for models without a calibrated floor."""
    return by_base(model, FLOORS, None).cast("double")


def token_prices(model: Column, override: tuple[float | None, float | None] = (None, None)) -> Column:
    """struct<input_per_m, output_per_m>: an override, else the model's own, else the default."""
    own = [F.lit(x) for x in DEFAULT_PRICE]
    for name, price in PRICES.items():
        own = [F.when(model == name, F.lit(p)).otherwise(o) for p, o in zip(price, own)]
    return F.struct(*[(F.lit(v) if v is not None else o).cast("double").alias(n) for v, o, n in zip(override, own, ("input_per_m", "output_per_m"))])


def embedding_cost(target: Column, tokens: Column, per_m: float = EMBED_PRICE) -> Column:
    return F.when(target == "cloud", tokens * per_m / 1_000_000).otherwise(F.lit(0.0))


def completion_tokens(prompt: Column, completion: Column, total: Column) -> Column:
    """The larger of the count given and what the total leaves; null without a prompt count."""
    return F.when(prompt.isNotNull(), F.greatest(F.coalesce(completion, F.lit(0)), F.coalesce(total, F.lit(0)) - prompt))


def han_share(text: Column) -> Column:
    han, latin = F.regexp_count(text, F.lit(r"\p{IsHan}")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return han / F.greatest(F.lit(1), han + latin)


def in_language(text: Column, language: Column) -> Column:
    return F.when(language == "en", han_share(text) < 0.05).otherwise(han_share(text) > 0.3)


def clamp_limit(n: int, low: int = LIMITS[0], high: int = LIMITS[1]) -> int:
    """A limit that a caller asked for, as one that a query may use."""
    return max(low, min(int(n), high))


def clamped(n: Column, low: int = LIMITS[0], high: int = LIMITS[1]) -> Column:
    return F.greatest(F.lit(low), F.least(F.floor(n), F.lit(high)))


def allowed_targets(strategy: Column) -> Column:
    both = F.array(F.lit("local"), F.lit("cloud"))
    return F.when(strategy == "only-local", F.array(F.lit("local"))).when(strategy == "only-cloud", F.array(F.lit("cloud"))).otherwise(both)


def banned_words(*parts: Column) -> Column:
    """Whether any rule bans what the parts that are there say, a line for each."""
    filled = [F.when(p != "", p) for p in parts]
    return F.concat_ws("\n", *filled).rlike("|".join(BANNED))


def filled_entries(record: Column, keys: tuple[str, ...]) -> Column:
    """array<struct<key, value>> of the map's keys, in the order of ``keys``, whose values are not blank; values trimmed."""
    every = F.array(*[F.struct(F.lit(k).alias("key"), tx.strip(F.try_element_at(record, F.lit(k))).alias("value")) for k in keys])
    return F.filter(every, lambda x: F.coalesce(x["value"] != "", F.lit(False)))


def tool_arguments(raw: Column, schema: str, required: tuple[str, ...]) -> Column:
    """struct<args, error>: the JSON object, or why it is none."""
    parsed, args = F.try_parse_json(raw), F.from_json(raw, schema)
    lacking = F.array_compact(F.array(*[F.when(args[k].isNull(), F.lit(k)) for k in required]))
    error = F.when(parsed.isNull() | ~F.trim(raw).startswith("{"), F.lit("not a JSON object")).when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
    return F.struct(F.when(error.isNull(), args).alias("args"), error.alias("error"))


def outer_json(raw: Column, schema: str) -> Column:
    """The JSON from the first brace to the last one; null if it is none."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), F.from_json(body, schema))


def judge_score(x: Column) -> Column:
    """Rounded, 1 to 5; null of null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.floor(x + 0.5).cast("int"))))


def plan_error(raw: Column) -> Column:
    """Why ``plans.parse_plan`` gives no plan, in words; null if it gives one."""
    from .plans import parse_plan

    return F.when(parse_plan(raw).isNotNull(), F.lit(None)).when(F.try_parse_json(unfenced(raw)).isNull(), F.lit("not valid JSON")).otherwise(F.lit("does not follow the schema of a plan"))


# -- dates


def long_date(day: Column, locale: str) -> Column:
    """As a person of the locale (en or zh) writes a day."""
    return F.date_format(day, "yyyy年M月d日" if locale == "zh" else "MMMM d, yyyy")


def month_label(month: Column, locale: str) -> Column:
    """struct<year, month> of a first day, for a list of months."""
    return F.struct(F.date_format(month, "yyyy").alias("year"), F.date_format(month, "M月" if locale == "zh" else "MMM").alias("month"))


def item_count(n: Column, locale: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" 条")) if locale == "zh" else F.when(n == 1, "1 item").otherwise(F.concat(n.cast("string"), F.lit(" items")))


def minutes_left(deadline: Column, now: Column) -> Column:
    """Whole minutes, rounded up; null if the deadline is due. Times count in milliseconds, to which microseconds are rounded."""
    at = lambda t: F.round(F.unix_micros(t), -3)
    left = F.ceil((at(deadline) - at(now)) / 60_000_000)
    return F.when(left > 0, left)


def compact_time(iso: Column) -> Column:
    """An ISO time of UTC with a blank for the T, and without seconds that are zero; other text with its line breaks escaped."""
    seconds = F.regexp_extract(iso, ISO, 3)
    shown = F.concat(F.regexp_extract(iso, ISO, 1), F.lit(" "), F.regexp_extract(iso, ISO, 2), F.when(seconds.rlike(r"^:00(?:\.0+)?$"), F.lit("")).otherwise(seconds), F.lit("Z"))
    return F.when(iso.rlike(ISO), shown).otherwise(F.regexp_replace(iso, "\r?\n", r"\\n"))


ISO = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2})(:\d{2}(?:\.\d+)?)?Z$"

# -- prompts


def rerank_prompt(query: Column, passages: Column) -> Column:
    """Numbered passages of an array<struct<title, heading, text>>, each cut to ``PASSAGE_CHARS``."""
    one = lambda p, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("] "), p["title"], F.lit(" › "), p["heading"], F.lit("\n"), F.substring(p["text"], 1, PASSAGE_CHARS))
    return F.concat(F.lit("Query: "), query, F.lit("\n\nPassages:\n\n"), F.array_join(F.transform(passages, one), "\n\n"), F.lit("\n\nReturn a score for every passage id (P1…P"), F.size(passages).cast("string"), F.lit(")."))


def knowledge_text(query: Column, how: Column, hits: Column, reranked: Column) -> Column:
    """What a model is given of a search: numbered passages of an array<struct<doc_id, title, heading, text>>, with what it may cite."""
    # The wording.
    caveat = " Passages are ranked by similarity and may not answer the question: use only those that directly address it, and if none does, say the knowledge base has no applicable document instead of applying a procedure written for a different alarm or equipment."
    one = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["doc_id"], F.lit(" · "), h["title"], F.lit(" › "), h["heading"], F.lit("\n"), h["text"])
    head = F.concat(F.lit('Knowledge search "'), query, F.lit('" ('), how, F.lit(")"))
    full = F.concat(head, F.lit(". Cite the document ID (e.g. "), F.get(hits, F.lit(0))["doc_id"], F.lit(") in refs when you use a passage."), F.when(reranked, "").otherwise(caveat), F.lit("\n\n"), F.array_join(F.transform(hits, one), "\n\n"))
    return F.when(F.size(hits) == 0, F.concat(head, F.lit(": no relevant document. Do not cite any document for this."))).otherwise(full)


def prompt_outline(messages: Column) -> Column:
    """The last of an array<struct<role, name, content>>, headed by what was sent before it; tool results with their lengths."""
    tag = r'^<tool_result name="([^"]+)">'
    before = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    content = lambda m: F.coalesce(m["content"], F.lit(""))
    tool = lambda m: F.when(m["role"] == "tool", F.coalesce(m["name"], F.lit(""))).otherwise(F.regexp_extract(content(m), tag, 1))
    body = lambda m: tx.strip(F.regexp_replace(F.regexp_replace(content(m), tag, ""), r"</tool_result>$", ""))
    tools = F.transform(F.filter(before, lambda m: tool(m) != ""), lambda m: F.concat(tool(m), F.lit(" ("), F.format_number(F.length(body(m)), 0), F.lit(" chars)")))
    count = lambda role: F.size(F.filter(before, lambda m: (tool(m) == "") & (m["role"] == role)))
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    hidden = F.array_compact(F.array(F.when(count("system") > 0, F.lit("system prompt")), F.when(count("user") > 0, plural(count("user"), "earlier user message")), F.when(count("assistant") > 0, plural(count("assistant"), "assistant message")), F.when(F.size(tools) > 0, F.concat(plural(F.size(tools), "tool result"), F.lit(": "), F.array_join(tools, ", ")))))
    last = F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))
    return F.when(F.size(hidden) > 0, F.concat(F.lit("[Also sent, not shown: "), F.array_join(hidden, " · "), F.lit("]\n\n"), last)).otherwise(last)


# -- the guard of a request


def kept_history(history: Column) -> Column:
    """The last messages of an array<struct<role, content>> that users and assistants wrote, the oldest going until the rest is short enough."""
    none = F.array().cast("array<struct<role:string,content:string>>")
    valid = F.transform(F.filter(F.coalesce(history, none), lambda m: m["role"].isin("user", "assistant") & m["content"].isNotNull()), lambda m: F.struct(m["role"].alias("role"), tx.sanitize(m["content"]).alias("content")))
    last = lambda v: F.slice(v, F.greatest(F.size(v) - MAX_MESSAGES + 1, F.lit(1)), F.lit(MAX_MESSAGES))
    step = lambda acc, m: F.struct((acc["total"] + F.length(m["content"])).alias("total"), F.when(acc["total"] + F.length(m["content"]) <= MAX_HISTORY, F.concat(F.array(m), acc["out"])).otherwise(acc["out"]).alias("out"))
    return tx.let(valid, lambda v: F.aggregate(F.reverse(last(v)), F.struct(F.lit(0).alias("total"), none.alias("out")), step, lambda acc: acc["out"]))


def guard_input(text: Column, history: Column) -> Column:
    """struct<rule, detail, input, history, trimmed, sensitive>: the rule that blocks a request (null if none does) and what goes on to a model."""
    own = tx.strip(tx.sanitize(text))

    def checked(kept):
        users = F.concat(F.array(own), F.transform(F.filter(kept, lambda m: m["role"] == "user"), lambda m: m["content"]))
        found = F.get(F.filter(F.transform(users, tx.injection_excerpt), lambda x: x["rule"].isNotNull()), F.lit(0))
        rule = F.when(F.length(own) > MAX_INPUT, "input_too_long").when(found["rule"].isNotNull(), "prompt_injection")
        all_ = F.array_join(F.concat(F.array(own), F.transform(kept, lambda m: m["content"])), "\n")
        none = F.array().cast("array<struct<id:string,kind:string,n:int>>")
        trimmed = F.size(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))) - F.size(kept)
        detail = F.when(rule == "prompt_injection", F.concat(found["rule"], F.lit(": "), found["excerpt"]))
        return F.struct(rule.alias("rule"), detail.alias("detail"), own.alias("input"), kept.alias("history"), trimmed.alias("trimmed"), F.when(rule.isNull(), tx.sensitive_findings(all_)).otherwise(none).alias("sensitive"))

    return tx.let(kept_history(history), checked)


# -- nested records


def run_records(runs: DataFrame) -> DataFrame:
    """Runs with their usage and cache columns as structs, null where a run has none, and levels only of known names."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = lambda c, *names: F.when(F.col(c).isin(*names), F.col(c))
    usage = F.when(F.col("prompt_tokens").isNotNull(), F.struct("prompt_tokens", zero("completion_tokens").alias("completion_tokens"), zero("cost_usd").alias("cost_usd"), zero("saved_usd").alias("saved_usd")))
    cache = F.when(F.col("cache_entry_id").isNotNull(), F.struct(F.col("cache_entry_id").alias("entry_id"), zero("cache_saved_ms").alias("saved_ms")))
    return runs.select("id", "created_at", "task_type", "status", "fell_back", "ttft_ms", "total_ms", usage.alias("usage"), cache.alias("cache"), known("difficulty", "simple", "complex").alias("difficulty"), known("model_tier", "standard", "strong").alias("tier"), F.coalesce("escalated", F.lit(False)).alias("escalated"))


def observation(status: Column, kind: Column, model: Column, prompt: Column, completion: Column, cost: Column, target: Column) -> Column:
    """A span as the attributes of a trace export: level, metadata, and for model calls model, usage and cost."""
    call = kind.isin("generation", "embedding")
    level = F.when(status == "error", "ERROR").when(status == "warning", "WARNING").otherwise("DEFAULT")
    entry = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    metadata = F.map_from_entries(F.array_compact(F.array(entry("target", target), F.when(~call, entry("model", model)))))
    usage = F.when(call & prompt.isNotNull(), F.struct(prompt.alias("input"), completion.alias("output"), (prompt + completion).alias("total")))
    return F.struct(level.alias("level"), metadata.alias("metadata"), F.when(call, model).alias("model"), usage.alias("usage"), F.when(call, cost).alias("cost"))


def migrated_orders(orders: DataFrame, now: Column) -> DataFrame:
    """Orders of an older store: funds inferred from the status where they are unknown, deadlines from the time of the order."""
    funds = F.when(F.col("funds").isin("held", "refunded", "released"), F.col("funds")).when(F.col("status") == "completed", "released").when(F.col("status").isin("cancelled", "rejected"), "refunded").otherwise("held")
    created = F.coalesce("created_at", now)
    return orders.withColumns({"id": F.col("id").cast("string"), "funds": funds, "created_at": created, "accept_by": F.coalesce("accept_by", created)})
