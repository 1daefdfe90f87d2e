"""Secret scans with DataFrame functions only: patterns, and the Shannon entropy of a sliding window.

Three patterns give the base spans. The method adds spans of kind ``entropy``: candidate strings are runs of at least 20
characters of tokens with both letters and digits; each belongs to a character class (hexadecimal, alphanumeric, or with
signs as well) with its own threshold. A window of 20 characters slides over it; the counts of the characters in the
window and the sum of c log2 c over them are kept up to date for the character that enters and the one that leaves, in
whole millionths, so that the result does not depend on the order of sums. The span runs from the first window whose
entropy reaches the threshold to the end of the last. Candidates on the allow list, judged with the 24 characters before
them, give none; nor do those that lie within a base span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Bits for each character, by class of the candidate.
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "signs": 3.8}
#: Matched against the context and the candidate.
ALLOW = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)example|sample|placeholder|changeme|xxxx|test[-_]?key|your[-_]",
    r"(?i)(sha-?(1|224|256|384|512)|md5|commit|revision|checksum|digest|etag|integrity)[-:=\x20]{1,3}[\"']?[0-9a-z+/=_-]*$",
    r"(?i)(://|www\.)[^\s]*$",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
)
MILLION = 1_000_000
#: Outputs gathered at a time, and counts in one integer.
BLOCK, PACKED = 256, 12


def _fold(items: Column, state: Column, step, kind: str) -> Column:
    """The outputs of ``step(state, item) -> (state, output)`` over the items in order; ``kind`` is the outputs' type.

    Arrays cannot grow in place, so outputs are gathered in blocks of ``BLOCK`` and these in turn: the cost is in
    proportion to the number of items for any that a text can hold.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc, first):
        inner = F.aggregate(F.slice(items, first, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), block, lambda acc: F.flatten(acc["out"]))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m,before>>: all matches of a pattern, leftmost and non-overlapping, in code points, with the text since the last one.

    The parts between the matches and the matches alternate, so lengths add up to the places.
    """
    kind = "struct<s:int,e:int,m:string,before:string>"

    def placed(found):
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(between, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

        def step(at, x):
            s = at + F.length(x["g"])
            return s + F.length(x["m"]), F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["g"].alias("before"))

        return let(pairs, lambda p: _fold(p, F.lit(0), step, kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _spans(text: Column, pattern: str, kind: int, keep, gate: str) -> Column:
    """array<struct<s,k,e>> of the matches that ``keep`` accepts; ``gate`` finds texts without any cheaply."""
    kept = F.transform(F.filter(_matches(text, pattern), keep), lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))
    return F.when(text.rlike(gate), kept).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def _base(text: Column) -> tuple[Column, Column, Column]:
    """The spans of the three patterns."""
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 8
    # a run of hex digits of fewer than 32 is dropped anyway, so the pattern need not match it
    return _spans(text, ASSIGN, 0, value, ASSIGN), _spans(text, ACCESS, 1, lambda x: F.length(x["m"]) >= 16, "AKIA[A-Z0-9]{12}"), _spans(text, "[0-9a-f]{32,}", 2, lambda x: F.length(x["m"]) >= 32, "[0-9a-f]{32}")


def entropy_range(token: Column) -> Column:
    """struct<first, last>: start of the first window that reaches the threshold of the token's class and end of the last; -1 if none.

    The counts of the 66 signs are five bits each of six integers, twelve to an integer, so a step costs the same for
    any length of the token: one sign is added, one taken away.
    """
    log = F.array(*[F.lit(0 if c < 2 else round(c * math.log2(c) * MILLION)).cast("long") for c in range(WINDOW + 1)])
    level = lambda bits: F.lit(round(WINDOW * (math.log2(WINDOW) - bits) * MILLION)).cast("long")  # noqa: E731  the sum that a window may have at most
    most = F.when(token.rlike("^[0-9a-fA-F]+$"), level(THRESHOLDS["hex"])).when(token.rlike("^[0-9A-Za-z]+$"), level(THRESHOLDS["alnum"])).otherwise(level(THRESHOLDS["signs"]))
    names = [f"c{k}" for k in range(-(-len(SYMBOLS) // PACKED))]
    place = lambda code: ((code % PACKED) * 5).cast("int")

    def held(counts, code):
        word = F.get(F.array(*[counts[n] for n in names]), F.floor(code / PACKED).cast("int"))
        return F.call_function("shiftright", word, place(code)).bitwiseAND(F.lit(31)).cast("int")

    def moved(counts, code, by):
        one = F.call_function("shiftleft", F.lit(by).cast("long"), place(code))
        return F.struct(*[(counts[n] + F.when(F.floor(code / PACKED) == k, one).otherwise(F.lit(0).cast("long"))).alias(n) for k, n in enumerate(names)])

    def run(codes, limit):
        steps = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("new"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1)).alias("old")))
        zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
        start = F.struct(zero.alias("c"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

        def step(acc, x):
            left = let(held(acc["c"], x["old"]), lambda n: F.struct(moved(acc["c"], x["old"], -1).alias("c"), (acc["sum"] - F.get(log, n) + F.get(log, n - 1)).alias("sum")))
            left = F.when(x["old"] >= 0, left).otherwise(F.struct(acc["c"].alias("c"), acc["sum"].alias("sum")))
            both = let(left, lambda a: let(held(a["c"], x["new"]), lambda n: F.struct(moved(a["c"], x["new"], 1).alias("c"), (a["sum"] - F.get(log, n) + F.get(log, n + 1)).alias("sum"))))

            def after(a):
                hot = (x["i"] >= WINDOW - 1) & (a["sum"] <= limit)
                first = F.when(hot & (acc["first"] < 0), x["i"] - (WINDOW - 1)).otherwise(acc["first"])
                return F.struct(a["c"].alias("c"), a["sum"].alias("sum"), first.alias("first"), F.when(hot, x["i"] + 1).otherwise(acc["last"]).alias("last"))

            return let(both, after)

        return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    return let(F.filter(codes, lambda c: c >= 0), lambda c: let(most, lambda limit: run(c, limit)))


def _entropy_spans(text: Column, base: Column) -> Column:
    """Spans of the method. One sweep over base spans and candidates in order of their starts tells which lie within a base span."""
    allowed = "|".join(f"(?:{p})" for p in ALLOW)
    kind = "struct<s:int,e:int,m:string,held:boolean>"

    def candidates(found):
        # the 24 characters before a candidate: of the gap, or else of the candidate before and its own gap
        def context(x, i):
            last = F.get(found, i - 1)
            near = F.when(F.length(x["before"]) >= 24, x["before"]).otherwise(F.concat(F.coalesce(F.concat(F.right(last["before"], F.lit(24)), last["m"]), F.lit("")), x["before"]))
            return F.concat(F.right(near, F.lit(24)), x["m"])

        named = F.transform(found, lambda x, i: F.struct(x["s"].alias("s"), F.lit(1).alias("k"), x["e"].alias("e"), x["m"].alias("m"), (x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~context(x, i).rlike(allowed)).alias("ok")))
        own = F.transform(base, lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("k"), b["e"].alias("e"), F.lit("").alias("m"), F.lit(False).alias("ok")))
        every = F.array_sort(F.concat(own, F.filter(named, lambda x: x["ok"])))

        def step(reach, x):
            after = F.when(x["k"] == 0, F.greatest(reach, x["e"])).otherwise(reach)
            return after, F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), ((x["k"] == 0) | (reach >= x["e"])).alias("held"))

        return let(every, lambda e: F.filter(_fold(e, F.lit(-1), step, kind), lambda x: ~x["held"]))

    ranged = F.transform(let(_matches(text, CANDIDATE), candidates), lambda x: F.struct(x["s"].alias("s"), entropy_range(x["m"]).alias("r")))
    spans = F.transform(F.filter(ranged, lambda x: x["r"]["first"] >= 0), lambda x: F.struct((x["s"] + x["r"]["first"]).alias("s"), F.lit(3).alias("k"), (x["s"] + x["r"]["last"]).alias("e")))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans (array<struct<s,k,e>>: start, kind, end in code points): one row per row of ``docs``; no shuffle.

    Null and empty texts have no spans; repeated rows stay, as do rows without an id; an empty table gives no rows;
    further columns are not carried, whatever their names. The cost grows in proportion to the length of a text and of
    any candidate in it. Spans that start at the same place come in the order of their kinds.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    a, k, h = _base(text)
    rows = rows.select("doc_id", "_text", a.alias("a"), k.alias("k"), h.alias("h"))
    rows = rows.select("doc_id", "_text", "a", "k", "h", F.concat("a", "k", "h").alias("base"))
    return rows.select("doc_id", "a", "k", "h", "base", F.concat("base", _entropy_spans(text, F.col("base"))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy. Rows as in ``scan``."""
    found = scan(docs)
    count = lambda c: F.size(c).cast("long")
    return found.select("doc_id", count("a").alias("n_assign"), count("k").alias("n_access"), count("h").alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_entropy"))


def _cut(text: Column, spans: Column) -> Column:
    """The text with each of the sorted spans, which do not overlap, replaced. Parts are cut from stretches of many spans, so a part far back costs no walk through the whole text."""
    end = lambda i: F.when(i > 0, F.get(spans, i - 1)["e"]).otherwise(F.lit(0))

    def stretch(first):
        last = F.least(first + F.lit(BLOCK - 1), F.size(spans) - 1)
        part = F.substring(text, end(first) + 1, F.get(spans, last)["s"] - end(first))
        return let(part, lambda p: F.transform(F.sequence(first, last), lambda i: F.substring(p, end(i) - end(first) + 1, F.get(spans, i)["s"] - end(i))))

    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(BLOCK)), stretch))
    rest = F.substring(text, end(F.size(spans)) + 1, F.length(text))
    return F.array_join(F.concat(parts, F.array(rest)), "[SECRET]")


def _merged(spans: Column) -> Column:
    """array<struct<s,e>>: sorted spans as stretches that neither overlap nor touch inside each other."""

    def step(reach, x):
        return F.greatest(reach, x["e"]), F.struct(x["s"].alias("s"), F.greatest(reach, x["e"]).alias("e"), (x["s"] < reach).alias("joined"))

    def stretches(marked):
        # a stretch starts at a span that does not begin within the ones before, and reaches as far as the last of its spans does
        starts = F.filter(F.transform(marked, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x["joined"].alias("joined"))), lambda x: ~x["joined"])
        return let(starts, lambda b: F.transform(b, lambda x, j: F.struct(x["s"].alias("s"), F.get(marked, F.coalesce(F.get(b, j + 1)["i"], F.size(marked)) - 1)["e"].alias("e"))))

    return let(_fold(spans, F.lit(-1), step, "struct<s:int,e:int,joined:boolean>"), stretches)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``[SECRET]``; overlapping spans are one. All other columns stay.

    Null texts stay null and empty ones empty; repeated rows stay; an empty table gives no rows.
    """
    own = F.col(text_col)
    text = F.coalesce(own, F.lit(""))
    spans = let(F.concat(*_base(text)), lambda b: F.concat(b, _entropy_spans(text, b)))
    cleaned = let(spans, lambda s: F.when(F.size(s) == 0, own).otherwise(let(F.array_sort(s), lambda sorted_: let(_merged(sorted_), lambda m: _cut(text, m)))))
    return docs.withColumn(text_col, cleaned)
