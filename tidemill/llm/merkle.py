"""A Merkle manifest of a dataset, with the proof of every row, by preimages of parents.

A leaf is the digest of a row. Within a group (a source) the leaves stand in order, and every ``WIDTH`` consecutive nodes
of a level become a parent whose hash is that of its preimage, the children's hashes one after the other; the single node
that is left is the group's subroot, and the subroots in order of their groups make a tree of the same kind up to the root.

Only the preimages are stored, one row for each parent. From the root down, a parent hands its children the path above
it, so each child's path is one join with exactly ``WIDTH`` rows to a key, whatever the size of its group; no row is
joined with an ancestor that many rows share. A leaf then has the preimages of all its ancestors and its slot in each:
cutting the slot of 64 characters out leaves the siblings, which are its proof, and putting another hash there and hashing
upwards folds a changed row to the root that it would give.

Levels are as many as the logarithm of the rows to the base of ``WIDTH``; each is written down once. Texts are read once
and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import spill_table
from .ranking import group_key, places

#: Children of a parent, and characters of a hash.
WIDTH, HASH = 16, 64
#: What a leaf is the digest of, in this order (fixed).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<preimage:string,slot:int>>"


def row_hash(values: list[Column]) -> Column:
    """The digest of a row: of each value, '-' if null, else its length in UTF-8 bytes, a colon, and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _gathered(nodes: DataFrame, *more: Column) -> DataFrame:
    """Parents of nodes (g, place, hash): g, place, preimage, alone. ``alone`` if the child is all that its group has left."""
    kids = F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), F.col("hash"), *more)))
    out = nodes.groupBy("g", F.floor(F.col("place") / WIDTH).alias("up")).agg(kids.alias("kids"))
    out = out.select("g", F.col("up").alias("place"), F.array_join(F.col("kids.hash"), "").alias("preimage"), ((F.col("up") == 0) & (F.size("kids") == 1)).alias("alone"), *([F.col("kids")] if more else []))
    return spill_table(out, "merkle-level")


def levels_of(nodes: DataFrame, *more: Column) -> list[DataFrame]:
    """The preimages of all levels, the lowest first: each group goes up until one node is left. ``more`` stays with the lowest children."""
    out = [_gathered(nodes, *more)]
    while not out[-1].where(~F.col("alone")).isEmpty():
        out.append(_gathered(out[-1].where(~F.col("alone")).select("g", "place", F.sha2("preimage", 256).alias("hash"))))
    return out


def paths_of(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level with ``above``: the path from the node that its preimage gives up to the root, of the lowest ancestor first.

    ``tops`` (g, above, ...) has the path of each group's last node.
    """
    more = [c for c in tops.columns if c not in ("g", "above")]
    below = None
    for k, level in reversed(list(enumerate(levels))):
        ended = level.where("alone").join(tops, "g")
        if below is not None:
            own = F.when(F.col("_alone"), F.col("_above")).otherwise(F.concat(F.array(F.struct(F.col("_preimage").alias("preimage"), F.pmod("place", F.lit(WIDTH)).cast("int").alias("slot"))), F.col("_above"))).cast(PATH)
            parents = below.select(F.col("g").alias("_g"), F.col("place").alias("_place"), F.col("preimage").alias("_preimage"), F.col("alone").alias("_alone"), F.col("above").alias("_above"), *more)
            open_ = level.where("not alone").join(parents, (F.col("g") == F.col("_g")) & (F.floor(F.col("place") / WIDTH) == F.col("_place")))
            ended = ended.unionByName(open_.withColumn("above", own).drop("_g", "_place", "_preimage", "_alone", "_above"))
        below = spill_table(ended, "merkle-path") if k else ended
    return below


def siblings(path: Column) -> Column:
    """All siblings along a path: each preimage without the slot."""
    return F.array_join(F.transform(path, lambda p: F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * HASH), F.substr(p["preimage"], p["slot"] * HASH + HASH + 1))), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` gives along a path: put into each preimage's slot, hashed, and so upwards."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * HASH), h, F.substr(p["preimage"], p["slot"] * HASH + HASH + 1)), 256))


def manifest(leaves: DataFrame, group_col: str, order: list[str], carried: list[str]) -> DataFrame:
    """``carried`` columns, leaf, subroot, root, path of every row of ``leaves`` (which has ``leaf``).

    Groups are ordered by the bytes of their text, null first, and are one group if their texts are equal. Rows are
    ordered by ``order`` (nulls first) and rows that tie by their leaves, so which of them stands first never matters.
    No rows give none. ``path`` holds preimage and slot of each ancestor, the parent first.
    """
    own = leaves.select(group_key(group_col).alias("g"), F.struct(*order).alias("_order"), F.struct(*carried).alias("_row"), F.col("leaf").alias("hash"))
    ranked = places(own, "g", ["_order", "hash"])
    levels = levels_of(ranked, F.col("_row"))
    subroots = levels[0].where("alone").select("g", F.col("preimage").alias("subroot"))
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("alone").select("g", F.col("preimage").alias("subroot")))
    tops = places(subroots.select("g", "subroot", F.lit("").alias("_one")), "_one", ["g"], 128)
    top = levels_of(tops.select(F.col("_one").alias("g"), "place", F.col("subroot").alias("hash"), F.col("g").alias("group")), F.col("group"))
    last = top[-1].where("alone").select("preimage").head()
    root = last[0] if last else None
    end = leaves.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(PATH).alias("above"))
    above = _children(paths_of(top, end)).select(F.col("kid.group").alias("g"), F.col("path").alias("above"), F.col("kid.hash").alias("subroot"))
    rows = _children(paths_of(levels, above))
    return rows.select("kid._row.*", F.col("kid.hash").alias("leaf"), "subroot", F.lit(root).alias("root"), "path")


def _children(lowest: DataFrame) -> DataFrame:
    """A row for each child of the lowest level, with its path."""
    one = lowest.select("*", F.explode("kids").alias("kid"))
    own = F.array(F.struct(F.col("preimage"), F.pmod(F.col("kid.at"), F.lit(WIDTH)).cast("int").alias("slot"))).cast(PATH)
    return one.withColumn("path", F.when(F.col("alone"), F.col("above")).otherwise(F.concat(own, "above")))


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, changed: the digest of each row, and that of the row as tampered with.

    Tampering lower-cases A to Z of the texts of rows whose crc32(doc_id as text) is divided by 5; rows without an id
    are never tampered with.
    """
    own = [F.col(f) for f in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = F.when(hit, row_hash([*own[:-1], F.translate(F.col("text"), UPPER, LOWER)]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), row_hash(own).alias("leaf"), changed.alias("changed"))


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's proof, checked against the tampered table.

    Rows are ordered by doc_id within their source, a null id first, and rows of one id by their leaves. Null values are
    marked as such in the leaf, so null and empty texts differ; texts may be of any length; repeated rows are leaves of
    their own. A tampered row is verified only if tampering changed nothing (no text, or none of A to Z in it). No rows
    give none. Further columns, whatever their names, are neither read nor part of a leaf.
    """
    rows = manifest(document_leaves(docs), "source", ["doc_id"], ["doc_id", "changed"])
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("path"), F.coalesce("changed", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def verify_sql(levels: int = 6, top_levels: int = 4) -> str:
    """The same rows in DuckDB's SQL, for sources of at most WIDTH ** levels rows and at most WIDTH ** top_levels sources."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::BIGINT)))"
    leaf = "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"
    parts = [
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf.format(text='text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 5 = 0 THEN {leaf.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents)",
        "n0 AS (SELECT *, leaf AS hash, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves)",
    ]
    for k in range(levels):
        parts.append(f"p{k} AS (SELECT g, place // {WIDTH} AS place, string_agg(hash, '' ORDER BY place) AS preimage, place // {WIDTH} = 0 AND count(*) = 1 AS alone FROM n{k} GROUP BY g, place // {WIDTH})")
        parts.append(f"n{k + 1} AS (SELECT g, place, sha256(preimage) AS hash FROM p{k} WHERE NOT alone)")
    parts.append("subroots AS (" + " UNION ALL ".join(f"SELECT g, preimage AS subroot FROM p{k} WHERE alone" for k in range(levels)) + ")")
    parts.append("t0 AS (SELECT g, subroot AS hash, row_number() OVER (ORDER BY g) - 1 AS place FROM subroots)")
    for k in range(top_levels):
        parts.append(f"q{k} AS (SELECT place // {WIDTH} AS place, string_agg(hash, '' ORDER BY place) AS preimage, place // {WIDTH} = 0 AND count(*) = 1 AS alone FROM t{k} GROUP BY place // {WIDTH})")
        parts.append(f"t{k + 1} AS (SELECT place, sha256(preimage) AS hash FROM q{k} WHERE NOT alone)")
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT preimage AS root FROM q{k} WHERE alone" for k in range(top_levels)) + ")")

    def climb(name: str, start: str, tables: list[str], group: str) -> str:
        """Adds the siblings and folds upwards, level by level; levels beyond a group's last change nothing."""
        out = start
        for k, level in enumerate(tables):
            step = WIDTH**k
            slot = f"((x.place // {step}) % {WIDTH}) * {HASH}"
            on = f"p.place = x.place // {step * WIDTH}" + (" AND p.g = x.g" if group else "")
            left, right = f"substr(p.preimage, 1, {slot})", f"substr(p.preimage, {slot} + {HASH + 1})"
            fold = f"CASE WHEN p.preimage IS NULL OR p.alone THEN x.folded ELSE sha256({left} || x.folded || {right}) END"
            more = f"CASE WHEN p.preimage IS NULL OR p.alone THEN x.proof ELSE x.proof || {left} || {right} END"
            parts.append(f"{name}{k} AS (SELECT x.* EXCLUDE (folded, proof), {fold} AS folded, {more} AS proof FROM {out} x LEFT JOIN {level} p ON {on})")
            out = f"{name}{k}"
        return out

    parts.append("f AS (SELECT doc_id, g, leaf, place, coalesce(changed, leaf) AS folded, '' AS proof FROM n0)")
    within = climb("a", "f", [f"p{k}" for k in range(levels)], "g")
    parts.append(f"b AS (SELECT x.doc_id, x.leaf, s.subroot, t0.place, x.folded, x.proof FROM {within} x JOIN subroots s USING (g) JOIN t0 USING (g))")
    over = climb("c", "b", [f"q{k}" for k in range(top_levels)], "")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {over}, root"
