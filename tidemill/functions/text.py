"""Text functions: columns built of Spark's own expressions, so they stay in the JVM."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

# Words that are not indexed.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "when", "with", "after", "must", "does", "do")
# A token is a word of ASCII with its codes, or a run of CJK signs.
TOKEN = r"[a-z0-9]+(?:[-_./][a-z0-9]+)*|[\x{3400}-\x{9fff}\x{f900}-\x{faff}]+"
#: A word border of ASCII letters, digits and the underscore, as \\b is in other engines; Java's follows Unicode.
_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_E = _B
# What counts as sensitive, in the order of redaction: (id, kind, pattern, replacement).
SENSITIVE = (
    ("private_key", "secret", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(-----END [A-Z ]*PRIVATE KEY-----|\z)", "[REDACTED_PRIVATE_KEY]"),
    ("api_key", "secret", rf"{_B}(sk-[A-Za-z0-9_-]{{20,}}|AKIA[0-9A-Z]{{16}}|AIza[0-9A-Za-z_-]{{35}}|gh[pousr]_[A-Za-z0-9]{{36,}}|xox[baprs]-[A-Za-z0-9-]{{10,}}){_B}", "[REDACTED_API_KEY]"),
    ("password_assignment", "secret", rf"(?i)({_B}(password|passwd|pwd)|密码)\s*[:=：]\s*\S{{4,}}", "[REDACTED_PASSWORD]"),
    ("cn_id_card", "pii", r"(?<!\d)\d{6}(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)", "[REDACTED_ID]"),
    ("cn_phone", "pii", r"(?<!\d)1[3-9]\d{9}(?!\d)", "[REDACTED_PHONE]"),
    ("email", "pii", rf"{_B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_B}", "[REDACTED_EMAIL]"),
)
# Attempts to override instructions, in order of precedence: (id, pattern).
INJECTION = (
    ("ignore_instructions", rf"(?i){_B}(ignore|disregard|forget|override){_E}.{{0,30}}{_B}(previous|prior|above|earlier|all|system|your){_E}.{{0,20}}{_B}(instructions?|prompts?|rules?|guidelines?){_E}"),
    ("ignore_instructions_zh", r"(忽略|无视|忘记|忘掉|跳过|不要遵守)(掉)?.{0,8}(之前|以上|上面|前面|上述|系统|你的).{0,6}(指令|指示|提示词?|规则|设定|要求|限制)|(忽略|无视|忘记|忘掉)(掉)?(所有|全部)的?(指令|指示|提示词?|设定)"),
    ("reveal_system_prompt", rf"(?i){_B}(reveal|show|print|repeat|output|leak|tell me){_E}.{{0,30}}{_B}(system prompt|hidden (instructions|prompt)|initial (instructions|prompt)|developer message){_E}"),
    ("reveal_system_prompt_zh", r"(?i)(输出|显示|打印|泄露|透露|告诉我|重复|复述).{0,12}(系统提示词|你的系统提示|system ?prompt|初始(指令|提示)|隐藏(指令|提示)|开发者(消息|指令))|(系统提示词|你的系统提示|system ?prompt|初始(指令|提示)|隐藏(指令|提示)|开发者(消息|指令)).{0,12}(输出|显示|打印|泄露|透露|发给我|告诉我|复述)"),
    ("jailbreak_mode", rf"(?i){_B}(developer mode|jailbreak|god mode|do anything now){_E}|越狱模式|开发者模式|无限制模式|不受任何限制"),
    ("jailbreak_dan", rf"{_B}DAN{_E}"),
    ("role_spoofing", r"(?im)<\|(im_start|im_end|system|endoftext|eot_id|start_header_id)\|>|^\s*\[?(system|assistant)\]?\s*[:：]"),
)


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, towards plus infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


@functools.cache
def _compatible() -> tuple[str, str, dict[str, str]]:
    """Signs of the basic plane whose compatible form holds what tokens are made of: those of one sign as two strings, the others as a map."""
    one, many = {}, {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        form = unicodedata.normalize("NFKC", c)
        if form != c and re.search(r"[A-Za-z0-9_./\-\u3400-\u9fff\uf900-\ufaff]", form) and (len(form) == 1 or re.search(r"[A-Za-z0-9\u3400-\u9fff]", form)):
            (one if len(form) == 1 else many)[c] = form
    return "".join(one), "".join(one.values()), many


def _ranges(signs, gap: int = 16) -> str:
    """A class of characters that holds all the signs: ranges, as a class of single signs is slow to test."""
    out: list[list[int]] = []
    for c in sorted(map(ord, signs)):
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def nfkc(text: Column) -> Column:
    """Every sign that matters to tokens in its compatible form (full width, ligatures, circled numbers). Marks are not composed with the letter before them."""
    old, new, many = _compatible()
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")  # one literal, folded by the optimizer
    spread = lambda x: F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    flat = F.translate(text, old, new)
    plain = F.octet_length(text) == F.length(text)  # of ASCII alone, which most texts are; far cheaper than the patterns
    return F.when(plain, text).when(~text.rlike(_ranges(old + "".join(many))), text).when(text.rlike(_ranges(many)), spread(flat)).otherwise(flat)


def tokenize(text: Column) -> Column:
    """Tokens in order: words, the parts of compound ones, pairs of neighbouring CJK signs."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    raw = F.regexp_extract_all(F.lower(nfkc(text)), F.lit(TOKEN), F.lit(0))
    return F.filter(F.flatten(F.transform(raw, token_parts)), lambda p: (p != "") & ~F.array_contains(stop, p))


def token_parts(t: Column) -> Column:
    """A raw token as an array: a compound word and its parts, or the pairs of a run of CJK signs."""
    compound = F.concat(F.array(t), F.split(t, "[-_./]"))
    pairs = F.when(F.length(t) == 1, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))
    return F.when(t.rlike("^[a-z0-9]+$"), F.array(t)).when(t.rlike("^[a-z0-9]"), compound).otherwise(pairs)


def token_counts(text: Column, terms: list[str]) -> Column:
    """struct<dl, tf>: the number of tokens of a text and, in the order of ``terms``, how many are each. One matching, no rows."""
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")

    def counted(tokens):
        hits = F.filter(tokens, lambda t: F.array_contains(wanted, t))
        tf = let(hits, lambda h: F.transform(wanted, lambda w: F.size(F.filter(h, lambda t: t == w))))
        return F.struct(F.size(tokens).alias("dl"), tf.alias("tf"))

    return let(F.coalesce(tokenize(text), F.array().cast("array<string>")), counted)


def token_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, term: a row for each token of each document, as ``tokenize`` gives them; a document without any has one row with a null.

    Each text is matched once, and everything after it are plain columns of rows.
    """
    raw = docs.select(F.col(id_col).alias("_id"), F.explode_outer(F.regexp_extract_all(F.lower(nfkc(F.col(text_col))), F.lit(TOKEN), F.lit(0))).alias("_t"))
    parts = raw.select("_id", F.explode_outer(token_parts(F.col("_t"))).alias("_p"))
    return parts.select("_id", F.when((F.col("_p") != "") & ~F.col("_p").isin(*STOPWORDS), F.col("_p")).alias("term"))


def sanitize(text: Column) -> Column:
    """Without invisible signs."""
    return F.regexp_replace(text, "[​-‏‪-‮⁠-⁤﻿­]", "")


def injection_rule(text: Column) -> Column:
    """The first rule that matches the text or the text with white space collapsed; null if none does."""
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.coalesce(*[F.when(text.rlike(p) | flat.rlike(p), F.lit(name)) for name, p in INJECTION])


def injection_excerpt(text: Column, most: int = 80) -> Column:
    """struct<rule, excerpt>: the first rule that matches and the start of what it matched; nulls if none does."""
    flat = F.regexp_replace(text, r"\s+", " ")
    found = lambda p: F.coalesce(F.nullif(F.regexp_extract(text, p, 0), F.lit("")), F.regexp_extract(flat, p, 0))
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("excerpt"))
    for name, p in reversed(INJECTION):
        out = F.when(text.rlike(p) | flat.rlike(p), F.struct(F.lit(name).alias("rule"), F.substring(found(p), 1, most).alias("excerpt"))).otherwise(out)
    return out


def sensitive_findings(text: Column, kinds: tuple[str, ...] = ("secret", "pii")) -> Column:
    """array<struct<id, kind, n>> of the rules that match."""
    found = [F.struct(F.lit(name).alias("id"), F.lit(kind).alias("kind"), F.regexp_count(text, F.lit(p)).alias("n")) for name, kind, p, _ in SENSITIVE if kind in kinds]
    return F.filter(F.array(*found), lambda x: x["n"] > 0)


def redact(text: Column) -> Column:
    for _, _, pattern, new in SENSITIVE:
        text = F.regexp_replace(text, pattern, new)
    return text


def describe_findings(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat(x["id"], F.lit("×"), x["n"].cast("string"))), ", ")


def reply_language(text: Column) -> Column:
    """en if plain Latin words outnumber Han signs, else zh."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_-])[A-Za-z]+(?![A-Za-z0-9_-])"), F.lit(0))
    plain = F.size(F.filter(words, lambda w: (F.length(w) > 1) & (w != F.upper(w))))
    return F.when(plain > F.regexp_count(text, F.lit(r"\p{IsHan}")), "en").otherwise("zh")


# Numerals, directions and kinds of question that a cached answer has to share.
EN_NUMBERS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "twenty": 20, "thirty": 30}
MARKS = (
    ("~up", rf"(?i)上升|升高|提高|提升|增加|增长|变好|改善|好转|回升|往上走|{_B}(?:ris(?:e|es|ing)|rose|increas\w*|improv\w*|higher|better|grow\w*|up){_E}"),
    ("~down", rf"(?i)下降|下滑|降低|减少|变差|恶化|下跌|走低|往下掉|{_B}(?:drop\w*|declin\w*|decreas\w*|fall\w*|fell|lower|worse|degrad\w*|dip\w*|down){_E}"),
    ("?why", rf"(?i)为什么|为啥|为何|原因|{_B}(?:why|caus\w*|reason\w*){_E}"),
    ("?how", rf"(?i)怎么|如何|怎样|{_B}how{_E}(?!\s+(?:many|much))"),
    ("?amount", rf"(?i)多少|{_B}how\s+(?:many|much){_E}"),
    ("?which", rf"(?i)哪些|哪几|列出|{_B}(?:which|list){_E}"),
)
LABELS = (r"(?<![A-Za-z])([A-Z])\s*(?=班|线|区|组)", rf"{_B}(?:[Ss]hift|[Ll]ine|[Bb]ay|[Aa]rea|[Cc]rew)\s+([A-Z]){_E}", rf"{_B}([A-Z])[-\s]shift{_E}")
ZH_COUNT = r"([零〇一二两三四五六七八九十]+)(?=个月|小时|星期|天|日|周|月|年|次|批|片|台|班)"


def chinese_number(x: Column) -> Column:
    """1 to 99 of a Chinese numeral; null for anything else."""
    digits = F.translate(x, "零〇一二两三四五六七八九", "001223456789")
    tens = F.when(digits.startswith("十"), F.lit(1)).otherwise(F.expr("try_cast(1 as int)"))
    left, right = F.substring_index(digits, "十", 1), F.substring_index(digits, "十", -1)
    tens = F.when(left == "", tens).otherwise(left.try_cast("int"))
    ones = F.when(right == "", F.lit(0)).otherwise(right.try_cast("int"))
    compound = F.when((F.length(left) <= 1) & (F.length(right) <= 1) & (F.length(digits) - F.length(F.replace(digits, F.lit("十"), F.lit(""))) == 1), tens * 10 + ones)
    value = F.when(digits.contains("十"), compound).when(F.length(digits) == 1, digits.try_cast("int"))
    return F.when(value > 0, value)


def key_terms(text: Column) -> Column:
    """Sorted distinct terms that two questions must share: ids and numbers, labels, direction, kind of question."""
    raw = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"), F.lit(0))
    numbers = F.create_map(*[F.lit(x) for k, v in EN_NUMBERS.items() for x in (k, str(v))])
    plain = lambda t: F.when(F.length(t) > 15, t).otherwise(F.regexp_replace(t, "^0+(?=.)", ""))
    term = lambda t: F.when(t.rlike("^[0-9]+$"), plain(t)).when(t.rlike("[0-9]"), F.upper(t)).when(t.rlike("^[A-Z]{2,}(?:-[A-Z0-9]+)+$"), t).otherwise(F.try_element_at(numbers, F.lower(t)))
    counts = F.transform(F.regexp_extract_all(text, F.lit(ZH_COUNT), F.lit(1)), lambda t: chinese_number(t).cast("string"))
    labels = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda t: F.concat(F.lit("#"), t)) for p in LABELS]
    marks = F.array(*[F.when(text.rlike(p), F.lit(m)) for m, p in MARKS])
    every = F.concat(F.transform(raw, term), counts, *labels, marks)
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: t.isNotNull())))


# Fixed values: (signal, weight, pattern).
SIGNALS = (
    ("comparison", 2, rf"(?i)对比|比较|相比|差异|区别|两条|两个|两台|两批|{_B}(?:vs\.?|versus|compar\w*|differen\w*|both){_E}"),
    ("causal", 1, rf"(?i)关联|有关|相关|影响|根因|{_B}(?:correlat\w*|related|root[\s-]cause|impact\w*){_E}"),
    ("why", 1, rf"(?i)为什么|为啥|为何|原因|{_B}why{_E}"),
    ("planning", 1, rf"(?i)行动计划|处理建议|优先级|{_B}(?:action\s+plan|prioriti\w*){_E}"),
)


def difficulty(text: Column, task: Column | None = None, history_chars: Column | None = None) -> Column:
    """struct<score, level, signals> of a question."""
    task = F.lit("chat") if task is None else task
    history_chars = F.lit(0) if history_chars is None else history_chars
    entities = F.size(F.filter(key_terms(text), lambda t: ~t.rlike("^[~?]") & ~t.rlike("^[0-9]+$")))
    tests = [("deep_task", 1, task.isin("analyze", "refactor")), ("multi_entity", 2, entities >= 2)]
    tests += [(name, weight, text.rlike(p)) for name, weight, p in SIGNALS]
    tests += [("very_long_input", 2, F.length(text) > 600), ("long_input", 1, (F.length(text) > 200) & (F.length(text) <= 600))]
    tests += [("multi_question", 1, F.regexp_count(text, F.lit("[?？]")) >= 2), ("long_history", 1, history_chars > 2000)]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))) for n, w, test in tests]), lambda x: x.isNotNull())
    found = F.when(task.isin("summarize", "polish", "continue", "translate", "tags"), F.slice(found, 1, 0)).otherwise(found)

    def summed(x):
        score = F.aggregate(x, F.lit(0), lambda a, s: a + s["weight"])
        return F.struct(score.alias("score"), F.when(score >= 3, "complex").otherwise("simple").alias("level"), F.transform(x, lambda s: s["name"]).alias("signals"))

    return let(found, summed)


def split_units(text: Column) -> Column:
    """List items whole, other lines by sentence."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    sentences = lambda x: F.when(x.rlike("[。！？；]"), F.regexp_extract_all(x, F.lit("[^。！？；]+[。！？；]?"), F.lit(0))).otherwise(F.split(x, r"(?<=[.!?])\s+"))
    units = lambda x: F.when(x.rlike(r"^(?:[-*]|\d+\.)\s"), F.array(x)).otherwise(F.filter(F.transform(sentences(x), strip), lambda s: s != ""))
    return F.flatten(F.transform(lines, units))


def pack_chunks(text: Column, most: int = 180) -> Column:
    """Units joined by line breaks while they fit; a longer unit stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, unit):
        joined = F.when(acc["cur"] == "", unit).otherwise(F.concat(acc["cur"], F.lit("\n"), unit))
        full = (acc["cur"] != "") & (F.length(joined) > most)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(full, unit).otherwise(joined).alias("cur"))

    return F.aggregate(split_units(text), start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def ungrounded(output: Column, evidence: Column) -> Column:
    """Ids, codes and percentages of ``output`` that neither stand in ``evidence`` nor follow from two of its numbers."""
    ids = [rf"{_B}B-\d{{6}}-\d{{2}}{_E}", rf"{_B}T-[A-Z]+-\d{{2}}{_E}", rf"{_B}[A-Z]{{2,}}(?:-[A-Z]{{2,}})+{_E}"]
    named = F.filter(F.concat(*[F.regexp_extract_all(output, F.lit(p), F.lit(0)) for p in ids]), lambda x: ~F.contains(evidence, x))
    bare = evidence
    for p in (r"\d{4}-\d{2}-\d{2}(T[\d:.]+Z?)?", *ids[:2]):
        bare = F.regexp_replace(bare, p, " ")
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: F.abs(x.cast("double"))))
    percents = F.regexp_extract_all(output, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1))

    def grounded(value, ns):
        near = lambda a: F.abs(a - value) <= 0.05
        ratio = lambda a, b: F.try_divide(a, b) * 100
        rounded = lambda r: (value == F.floor(value)) & (F.abs(F.floor(r + 0.5) - value) < 0.5)
        two = lambda a, b: (a != b) & (near(round_half_up(F.abs(a - b), 1)) | F.coalesce(near(ratio(a, b)) | rounded(ratio(a, b)), F.lit(False)))
        return (value == 0) | (value == 100) | F.exists(ns, near) | F.exists(ns, lambda a: F.exists(ns, lambda b: two(a, b)))

    loose = let(numbers, lambda ns: F.filter(percents, lambda p: ~grounded(p.cast("double"), ns)))
    return F.array_distinct(F.concat(named, F.transform(loose, lambda p: F.concat(p, F.lit("%")))))


def preview(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("… (+"), (F.length(text) - most).cast("string"), F.lit(")"))).otherwise(text)


def title_from_body(text: Column, most: int = 24) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, most)


def strip_html(text: Column, most: int = 280) -> Column:
    flat = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"[ \t\r\n]+", " ")
    return F.substring(F.trim(flat), 1, most)


def front_matter(text: Column) -> Column:
    """map of the keys between the leading ``---`` lines."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"))))


def sections(text: Column) -> Column:
    """array<struct<heading, body>> of the parts below ``## `` headings; those without heading or text are left out."""
    parts = F.slice(F.split(text, r"(?m)^##\s+"), 2, 100000)
    cut = F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "\n", 1)).alias("heading"), strip(F.when(p.contains("\n"), F.substring(p, F.instr(p, "\n") + 1, F.length(p))).otherwise("")).alias("body")))
    return F.filter(cut, lambda s: (s["heading"] != "") & (s["body"] != ""))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def exact_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; -1 if their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(-1.0))
