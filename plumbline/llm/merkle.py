"""Merkle manifest of a dataset: one tree per group of rows over a tree of the groups, with a proof for every row.

Rows are leaves in key order; while a group has several nodes, each run of `fanout` consecutive ones becomes their
hash, and the groups' roots become one root in the same way. A slot pivot does this: conditional aggregates spread the
nodes under one ancestor into slot columns. Concatenated runs of columns give the parents' hashes; a run without the
node's own column gives its siblings, left and right. One pivot spans `STEP` levels, so a tree of n leaves takes
log(n) / (STEP log(fanout)) shuffles, each of a fraction of the rows of the one before, and rows carry digests, never texts.
On the way back down a block of nodes gets the siblings of its ancestors by one join per pivot.

A group may hold most rows: its leaves are numbered by range placement, and its blocks are separate keys.

Defined results: a null field is hashed as `-`, so that null and empty differ; a null document id comes after all others and
is not tampered with; rows of one id go by the leaf hash, so equal rows are interchangeable; a null group comes first;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import stored
from plumbline.operators.ranking import running

FANOUT = 2
STEP = 4
_SIDES = "array<struct<before: string, after: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*parts), 256)


def sized(value: Column) -> Column:
    """A field as its byte count, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add `pos` (from 0) and `n` (rows of the group); a group is spread over ranges of its order."""
    ready = stored(rows.withColumn("_one", F.lit(1).cast("long")), "nodes")
    line = running(ready, group, order, {"_p": ("sum", "_one")})
    return line.select(*rows.columns, F.col("_p_before").cast("long").alias("pos"), F.col("_p_total").cast("long").alias("n"))


def _blocks(nodes: DataFrame, group: str, fanout: int, step: int) -> DataFrame:
    """group, block, n, slots c0.. (structs with the hash `h`), their siblings s0.. by level, and the hash on `top`."""
    width = fanout ** step
    slot = F.pmod(F.col("pos"), F.lit(width))
    held = F.struct(*[c for c in nodes.columns if c not in (group, "pos", "n")])
    wide = nodes.groupBy(group, F.floor(F.col("pos") / F.lit(width)).cast("long").alias("block")).agg(
        F.max("n").alias("n"), *[F.max(F.when(slot == i, held)).alias(f"c{i}") for i in range(width)])
    now = [F.col(f"c{i}.h") for i in range(width)]
    sides: list[list[Column]] = [[] for _ in range(width)]
    for level in range(step):
        inner = F.col("n") > fanout ** level  # else the level's only node is the group's root already
        parents = []
        for parent in range(len(now) // fanout):
            run = now[parent * fanout:(parent + 1) * fanout]
            filled = [F.coalesce(c, F.lit("")) for c in run]
            for own in range(fanout):
                before, after = F.concat(F.lit(""), *filled[:own]), F.concat(F.lit(""), *filled[own + 1:])
                pair = F.when(inner, F.struct(before.alias("before"), after.alias("after")))
                for i in range(fanout ** level):
                    sides[(parent * fanout + own) * fanout ** level + i].append(pair)
            parents.append(F.when(run[0].isNotNull(), F.when(inner, digest(filled)).otherwise(run[0])).alias(f"l{level}_{parent}"))
        wide = wide.withColumns({f"l{level}_{p}": c for p, c in enumerate(parents)})
        now = [F.col(f"l{level}_{p}") for p in range(len(parents))]
    return wide.select(group, "block", "n", *[f"c{i}" for i in range(width)], now[0].alias("top"),
                       *[F.array_compact(F.array(*sides[i])).alias(f"s{i}") for i in range(width)])


def tree(nodes: DataFrame, group: str, fanout: int = FANOUT, step: int = STEP) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (group, h) of nodes (group, pos, n, h, ...), and the stored layers from the leaves up."""
    width, layers = fanout ** step, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while not layers or most > 1:
        layers.append(stored(_blocks(nodes, group, fanout, step), "layer"))
        nodes = layers[-1].where(F.col("n") > width).select(group, F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(width)).cast("long").alias("n"), F.col("top").alias("h"))
        most = -(-most // width)
    roots = [layer.where(F.col("n") <= width).select(group, F.col("top").alias("h")) for layer in layers]
    return reduce(DataFrame.unionByName, roots), layers


def paths(layers: list[DataFrame], group: str, above: DataFrame | None = None, fanout: int = FANOUT, step: int = STEP) -> DataFrame:
    """Every leaf with its siblings level by level (`path`) and the `root`; `above` (group, path, root) continues a group's own root."""
    width, found = fanout ** step, None
    for layer in reversed(layers):
        ended = layer.where(F.col("n") <= width)
        if above is None:
            ended = ended.select("*", F.expr(f"cast(array() as {_SIDES})").alias("path"), F.col("top").alias("root"), F.col("top").alias("subroot"))
        else:
            own = above.select(F.col(group).alias("_g"), "path", "root")
            ended = ended.join(own, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("subroot", F.col("top"))
        if found is not None:
            own = found.select(F.col(group).alias("_g"), F.col("pos").alias("_b"), "path", "root", "subroot")
            inner = layer.where(F.col("n") > width).join(own, F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")
            ended = ended.unionByName(inner)
        slots = [F.struct(F.lit(i).alias("slot"), F.col(f"c{i}").alias("node"), F.col(f"s{i}").alias("sides")) for i in range(width)]
        found = ended.select(group, "block", "path", "root", "subroot", F.explode(F.array(*slots)).alias("z")).where("z.node is not null").select(
            group, (F.col("block") * width + F.col("z.slot")).alias("pos"), "z.node.*", F.concat(F.col("z.sides"), F.col("path")).alias("path"), "root", "subroot")
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, x: digest([x["before"], acc, x["after"]]))


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Per row its leaf, the roots, a digest of its proof, and the root that its (perhaps tampered) leaf leads to."""
    key = F.col("doc_id").cast("long")
    fields = {name: sized(F.col(name)) for name in FIELDS}
    tampered = fields | {"n_chars": sized(F.col("n_chars").cast("long") + 1)}
    struck = F.pmod(F.crc32(key.cast("string")), F.lit(7)) == 0
    leaves = docs.select(
        key.alias("doc_id"), F.col("doc_id").isNull().alias("last"), F.col("lang").cast("string").alias("lang"), digest(list(fields.values())).alias("h"),
        F.when(struck, digest(list(tampered.values()))).alias("other"))
    roots, layers = tree(numbered(leaves, ["lang"], ["last", "doc_id", "h"]), "lang", fanout)
    groups = numbered(roots.select(F.lit(0).alias("all"), "lang", "h"), ["all"], ["lang"])
    _, upper = tree(groups, "all", fanout)
    above = paths(upper, "all", None, fanout).select("lang", "path", "root")
    rows = paths(layers, "lang", above, fanout)
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    rows = rows.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded(F.coalesce("other", "h"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_H = "sha256({})"
_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = _H.format(" || ".join(_FIELD.format(c) for c in FIELDS))
_OTHER = _LEAF.replace("n_chars", "(n_chars + 1)")
#: CRC-32 of an ASCII text, bit by bit.
_CRC = ("xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), "
        "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
ORACLE_SQL = f"""
with recursive leaves as materialized (
  select doc_id, lang, {_LEAF} as leaf, case when {_CRC} % 7 = 0 then {_OTHER} end as other,
         row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as n
  from documents),
lower_tree(level, lang, pos, n, h) as (
  select 0, lang, pos, n, leaf from leaves
  union all
  select level + 1, lang, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by pos)) from lower_tree where n > 1 group by level, lang, pos // 2),
subroots as materialized (
  select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from lower_tree where n = 1),
upper_tree(level, pos, n, h) as (
  select 0, pos, n, h from subroots
  union all
  select level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by pos)) from upper_tree where n > 1 group by level, pos // 2),
steps as materialized (
  select l.doc_id, t.level, (l.pos >> t.level) % 2 as odd, coalesce(s.h, '') as sibling
  from leaves l join (select distinct level, lang, n from lower_tree where n > 1) t on l.lang is not distinct from t.lang
  left join lower_tree s on s.lang is not distinct from l.lang and s.level = t.level and s.pos = xor(l.pos >> t.level, 1)
  union all
  select l.doc_id, 1000 + t.level, (g.pos >> t.level) % 2, coalesce(s.h, '')
  from leaves l join subroots g on l.lang is not distinct from g.lang cross join (select distinct level from upper_tree where n > 1) t
  left join upper_tree s on s.level = t.level and s.pos = xor(g.pos >> t.level, 1)),
proofs as materialized (
  select doc_id, list({{'odd': odd, 'sibling': sibling}} order by level) as path from steps group by doc_id),
folds as (
  select l.doc_id, l.leaf, g.h as subroot, (select h from upper_tree where n = 1) as root, coalesce(p.path, []) as path,
         list_reduce(list_concat([{{'odd': 0::bigint, 'sibling': coalesce(l.other, l.leaf)}}], coalesce(p.path, [])),
                     lambda a, x: {{'odd': 0::bigint, 'sibling': sha256(case when x.odd = 1 then x.sibling || a.sibling else a.sibling || x.sibling end)}}).sibling as folded_root
  from leaves l join subroots g on l.lang is not distinct from g.lang left join proofs p on p.doc_id = l.doc_id)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.sibling), '')) as proof_sha256, folded_root, folded_root = root as verified
from folds
"""
