"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations


def crc32(number: str) -> str:
    """Unsigned crc32 of the decimal form of ``number``: bit by bit, a byte enters with the first of its eight steps."""
    bits = f"list_concat([4294967295], flatten(list_transform(string_split(cast({number} as varchar), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0])))"
    return f"xor(list_reduce({bits}, lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295)"


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Levels of the trees in the SQL: enough for 16**6 documents a source and 16**4 sources.
LEVELS, TOP_LEVELS = 6, 4


def _item(c: str) -> str:
    return f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"


def _tree(prefix: str, key: str, levels: int) -> str:
    """CTEs {prefix}1..: (key, idx, node) a level up from {prefix}0; {prefix}s0..: each node's siblings left and right (null once a key has one node)."""
    out, by = [], f"{key}, " if key else ""
    part = f"partition by {key}" if key else ""
    for k in range(levels):
        out.append(f"""{prefix}s{k} as (select {by}idx, count(*) over ({part}) as cnt,
  coalesce(string_agg(node, '' order by idx) over (partition by {by}idx // 16 order by idx rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(node, '' order by idx) over (partition by {by}idx // 16 order by idx rows between 1 following and unbounded following), '') as r from {prefix}{k})""")
        out.append(f"""{prefix}{k + 1} as (select {by}idx // 16 as idx, case when max(cnt) = 1 then max(node) else sha256(string_agg(node, '' order by idx)) end as node
  from (select *, count(*) over ({part}) as cnt from {prefix}{k}) group by {by}idx // 16)""")
    return ",\n".join(out)


def _climb() -> str:
    """CTEs c0..: proof text and folded node of every leaf, level by level."""
    out = []
    for k in range(LEVELS):
        out.append(f"""c{k + 1} as (select c.* replace (proof || case when s.cnt = 1 then '' else s.l || s.r end as proof,
  case when s.cnt = 1 then fold else sha256(s.l || fold || s.r) end as fold) from c{k} c join ls{k} s on s.g = c.g and s.idx = c.idx // {16 ** k})""")
    for k in range(TOP_LEVELS):
        out.append(f"""c{LEVELS + k + 1} as (select c.* replace (proof || case when s.cnt = 1 then '' else s.l || s.r end as proof,
  case when s.cnt = 1 then fold else sha256(s.l || fold || s.r) end as fold) from c{LEVELS + k} c join ts{k} s on s.idx = c.sidx // {16 ** k})""")
    return ",\n".join(out)


MERKLE = f"""
with d as (select doc_id, case when source is null then '' else 's' || source end as g,
    {' || '.join(_item(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} as head, text,
    doc_id is not null and {crc32('coalesce(doc_id, 0)')} % 5 = 0 as hit from documents),
h as (select doc_id, g, sha256(head || {_item('text')}) as leaf,
    sha256(head || {_item("case when hit then " + LOWERED.format('text') + " else text end")}) as altered from d),
o as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx from h),
l0 as (select g, idx, leaf as node from o),
{_tree('l', 'g', LEVELS)},
t0 as (select row_number() over (order by g) - 1 as idx, g, node from l{LEVELS}),
{_tree('t', '', TOP_LEVELS)},
c0 as (select o.*, t0.idx as sidx, t0.node as subroot, '' as proof, altered as fold from o join t0 using (g)),
{_climb()}
select doc_id, leaf, subroot, (select node from t{TOP_LEVELS}) as root, sha256(proof) as proof_sha256, fold as folded_root,
  fold = (select node from t{TOP_LEVELS}) as verified from c{LEVELS + TOP_LEVELS}"""


#: Nodes are told apart by the text of their turns, lengths first; rebuilt conversations are held as lists.
TRIE = f"""
with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as p from conversations where conv_id is not null),
ids as (select distinct c, c - c % 100 as b, {crc32('c')} % 6 as h from t),
n as (select c, max(p) as n from t group by c),
r as (select ids.c, t.p as d, role, text from ids join t on t.c = ids.b and t.p <= ids.h
  union all
  select ids.c, least(h, coalesce(n.n, 0)) + t.p - h, role, text from ids join t on t.c = ids.c and t.p > h left join n on n.c = ids.b),
k as (select c, d, length(text) as chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' order by d)
    over (partition by c order by d rows between unbounded preceding and current row)) as key from r),
m as (select c, cast(0 as bigint) as d, cast(0 as bigint) as chars, 'root' as key, cast(null as varchar) as up from ids
  union all select c, d, chars, key, coalesce(lag(key) over (partition by c order by d), 'root') from k),
len as (select c, max(d) as len from m group by c),
node as (select key, d, min(c) as conv_id, max(up) as up, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where d = len), '')) as ends_sha256
  from m join len using (c) group by key, d),
kids as (select up as key, count(*) as n from node where d > 0 group by up),
full_node as (select node.*, coalesce(kids.n, 0) as n_children from node left join kids using (key)),
line as (select distinct a.key as above, b.key as below from m a join m b on a.c = b.c and b.d >= a.d),
sums as (select above, cast(sum(case when n_children = 0 then 1 else 0 end) as bigint) as n_leaves, cast(sum((n_convs - 1) * chars) as bigint) as saved_tokens
  from line join full_node on below = key group by above)
select f.conv_id, f.d as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from full_node f join sums on above = f.key left join node p on p.key = f.up"""
