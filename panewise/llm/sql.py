"""DuckDB SQL that gives the rows of queries."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

HOST_RULES = rf"""
with d as (
    select row_number() over () rid, doc_id, source host, coalesce(text, '') t, {WORDS} w from documents),
l as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
g as (
    select rid, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] g
    from (select rid, w, unnest(generate_series(1, len(w) - 2)) i from d)),
again as (
    select rid, i from (select *, count(*) over (partition by rid, g) c from g) where c > 1),
covered as (
    select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from again) group by rid),
m as (
    select d.rid, doc_id, host, len(w)::bigint n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
        len(l)::bigint n_lines, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
        coalesce(covered.n, 0)::bigint n_repeat_words
    from d join l using (rid) left join covered using (rid)),
f as (
    select *, n_words < 50 a, 100 * n_repeat_words > 50 * n_words b,
        100 * n_symbols > 10 * word_chars c, 100 * n_dup_lines > 30 * n_lines e from m),
hosts as (select host, count(*) n, sum((a or b or c or e)::int) x from f group by host),
prior as (
    select sum(x) / sum(n) mean, sum(x::double * x / n) / sum(n) - (sum(x) / sum(n)) ** 2 v from hosts),
s as (
    select mean, least(greatest(case when v > 1e-9 then mean * (1 - mean) / v - 1 else 10000 end, 1), 10000) k from prior),
most as (select *, least(0.5, greatest(mean + 2 * sqrt(mean * (1 - mean) / (k + 1)), 2 * mean)) lim from s),
bad as (select host from hosts, most where (x + mean * k) / (n + k) > lim)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a or b base_failed,
    not (a or b) and not exists (select 1 from bad where bad.host is not distinct from f.host) kept
from f
"""

LINE_CHUNKS = r"""
with d as (
    select row_number() over () rid, coalesce(doc_id, 9223372036854775808::hugeint) id, doc_id, text,
        string_split(text, chr(10)) l from documents),
lines as (select rid, id, unnest(generate_series(1, len(l))) i, unnest(l) line from d where text is not null),
filled as (
    select *, lead(i) over (partition by rid order by i) nx from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
win as (
    select rid, id, i, nx from filled where nx is not null union all
    select rid, id, i, i from filled where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50),
text_of as (select win.*, array_to_string(list_slice(l, i, nx), chr(10)) content from win join d using (rid)),
later as (
    select rid, i, nx from (select *, row(id, i) > min(row(id, i)) over (partition by content) again from text_of)
    where again),
gone as (select distinct rid, unnest(generate_series(i, nx)) i from later),
rest as (
    select rid, string_agg(line, chr(10) order by i) text, count(*) n
    from lines where (rid, i) not in (select rid, i from gone) group by rid)
select d.doc_id, case when d.text is not null then coalesce(rest.text, '') end as text,
    len(l)::bigint n_lines, case when d.text is not null then len(l) - coalesce(rest.n, 0) end n_removed
from d left join rest using (rid)
"""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

CONTAMINATION = rf"""
with d as (select row_number() over () rid, doc_id, {_TERMS} w from documents),
i as (select item_id, {_TERMS} w from benchmark),
win as (
    select distinct item_id, least(len(w), 10) l, array_to_string(list_slice(w, pos, pos + least(len(w), 10) - 1), ' ') p
    from (select *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) pos from i where len(w) > 0)),
gram as (
    select rid, l, pos, array_to_string(list_slice(w, pos, pos + l - 1), ' ') p
    from (select rid, w, l, unnest(range(1, len(w) - l + 2)) pos from d, (select distinct l from win))),
hit as (select rid, pos, l, item_id from gram join win using (l, p)),
words as (select rid, count(distinct pos) n from (select rid, unnest(range(pos, pos + l)) pos from hit) group by rid),
named as (
    select rid, count(*) n, string_agg(item, ',' order by item) items
    from (select distinct rid, item_id::varchar item from hit where item_id is not null) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(words.n, 0)::bigint n_hit, coalesce(named.n, 0)::bigint n_items,
    sha256(coalesce(items, '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
from d left join words using (rid) left join named using (rid)
"""


def _leaf(text: str) -> str:
    fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# Fixed value: the polynomial of CRC-32, bits reversed.
_CRC32 = """xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, b:
    list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(a, b)), 4294967295::bigint), 4294967295)"""


def _levels(name: str, base: str) -> str:
    return f"""{name} as (
    select 0 lv, g, pos, n, node from {base} union all
    select lv + 1, g, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(node, '' order by pos))
    from {name} where n > 1 group by lv, g, pos // 16)"""


def _fold(name: str, base: str, tree: str) -> str:
    return f"""{name} as (
    select * from {base} union all
    select f.rid, f.lv + 1, f.g, f.pos // 16, (any_value(f.n) + 15) // 16,
        sha256(string_agg(case when t.pos = f.pos then f.node else t.node end, '' order by t.pos))
    from {name} f join {tree} t on f.n > 1 and t.lv = f.lv and t.g = f.g and t.pos // 16 = f.pos // 16
    group by f.rid, f.lv, f.g, f.pos)"""


def _siblings(base: str, tree: str, place: int) -> str:
    return f"""select b.rid, {place} tree, t.lv, t.pos, t.node from {base} b join {tree} t
    on t.g = b.g and t.n > 1 and t.pos // 16 = (b.pos // (16 ** t.lv)::bigint) // 16 and t.pos <> b.pos // (16 ** t.lv)::bigint"""


MANIFEST = f"""
with recursive d as (
    select row_number() over () rid, doc_id, coalesce('=' || source, '-') g, {_leaf("text")} node,
        case when {_CRC32} % 5 = 0 then {_leaf(_LOW)} end other from documents),
leaf as (
    select *, row_number() over (partition by g order by doc_id nulls first, node, rid) - 1 pos,
        count(*) over (partition by g) n from d),
{_levels("up", "leaf")},
top as (
    select 'all' g, g name, node, row_number() over (order by g) - 1 pos, count(*) over () n from up where n = 1),
{_levels("over", "top")},
{_fold("low", "(select rid, 0 lv, g, pos, n, coalesce(other, node) node from leaf)", "up")},
mid as (
    select low.rid, 0 lv, 'all' g, top.pos, top.n, low.node from low join top on low.n = 1 and top.name = low.g),
{_fold("high", "mid", "over")},
s as ({_siblings("leaf", "up", 0)} union all {_siblings("mid", "over", 1)}),
proof as (select rid, string_agg(node, '' order by tree, lv, pos) p from s group by rid)
select leaf.doc_id, leaf.node leaf, top.node subroot, root.node root, sha256(coalesce(p, '')) proof_sha256,
    high.node folded_root, high.node = root.node verified
from leaf join top on top.name = leaf.g join high on high.n = 1 and high.rid = leaf.rid
join (select node from over where n = 1) root on true left join proof on proof.rid = leaf.rid
"""
