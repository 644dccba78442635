"""DuckDB text for the registered queries that SQL can express.

Learned models, hash permutations, token ids and connected components have no counterpart in SQL; those queries are tested
against brute force instead.
"""

from __future__ import annotations


def _half_byte(value: int) -> int:
    """The CRC-32 remainder of half a byte."""
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


_TABLE = "[" + ", ".join(f"{_half_byte(i)}::bigint" for i in range(16)) + "]"


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of ``text``, which must not be empty."""
    pos = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || hex(encode({text}))[i:i+1])::bigint)"
    half = "xor({0} >> 4, (" + _TABLE + ")[({0} & 15) + 1])"
    step = half.format(half.format("xor(c, b)"))
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {pos}), lambda c, b: {step}), 4294967295::bigint)"


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::varchar)::varchar || ':' || {name}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes (tree, level, pos, n, hash) over leaves (tree, pos, n, hash)."""
    return f"""
        {name} as (
            select tree, 0 as level, pos, n, hash from {leaves}
            union all
            select tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' order by pos)) from {name}
            where n > 1 group by tree, level, pos // 2, n
        )"""


ORACLES: dict[str, str] = {
    "op2_exact_top_k": """
        with usable as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as terms
            from embeddings
            where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        ), scores as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                cast(list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: p[1] * p[2])) as bigint) as score
            from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
        from scores qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
    """,
    "op11_spelling_variants": f"""
        with recursive runs as (
            select doc_id, run, count(*) as times from (
                select doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run
                from documents
            ) group by doc_id, run
        ), hashed as (
            select run, times, {crc32("(coalesce(doc_id::varchar, '') || ':' || run)")} as h from runs
        ), counted as (
            select case when h % 31 = 0 then run[:(h % length(run))::int] || run[(h % length(run))::int + 2:] else run end as word,
                sum(times)::bigint as n
            from hashed group by word
        ), words as (
            select word, n from counted where length(word) >= 7 and n >= 2
        ), shorter as (
            select word, n, pos, word[:pos - 1] || word[pos + 1:] as left_over
            from (select word, n, unnest(range(1, length(word) + 1)) as pos from words)
        ), links as (
            select a.word as word, b.word as near, b.n as near_n from shorter a join shorter b
            on a.left_over = b.left_over and a.pos = b.pos and a.word <> b.word
            union
            select a.word, b.word, b.n from shorter a join words b on a.left_over = b.word
            union
            select b.word, a.word, a.n from shorter a join words b on a.left_over = b.word
        ), best as (
            select word, count(*) as n_near, first(near order by near_n desc, encode(near)) as near, max(near_n) as near_n
            from links group by word
        ), formed as (
            select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
                case when near_n >= 10 * w.n then near end as form, case when near_n >= 10 * w.n then near_n end as form_n
            from words w left join best b on w.word = b.word
        ), chain as (
            select word, word as root, 0 as steps from formed
            union all
            select c.word, f.form, steps + 1 from chain c join formed f on c.root = f.word where f.form is not null
        ), ends as (
            select word, arg_max(root, steps) as root from chain group by word
        )
        select f.word, form, root, n, n_near, form_n from formed f join ends e on f.word = e.word
    """,
    "op12_merkle_manifest": f"""
        with recursive leaves as (
            select doc_id, lang, {_leaf("n_chars")} as hash,
                case when coalesce({crc32("doc_id::varchar")} % 7 = 0, false) then {_leaf("(n_chars + 1)")} else {_leaf("n_chars")} end as found
            from documents
        ), trees as (
            select lang, row_number() over (order by lang nulls first) - 1 as tree, count(*) over () as trees
            from (select distinct lang from documents)
        ), placed as (
            select doc_id, found, hash, tree, trees, count(*) over (partition by tree) as n,
                row_number() over (partition by tree order by doc_id nulls first, hash) - 1 as pos
            from leaves l join trees t on l.lang is not distinct from t.lang
        ), {_tree("lower_tree", "placed")}, subroots as (
            select tree, hash as subroot from lower_tree where n = 1
        ), tops as (
            select 0 as tree, tree as pos, (select count(*) from subroots) as n, subroot as hash from subroots
        ), {_tree("upper_tree", "tops")}, above as (
            select p.tree, p.pos, o.level, o.pos % 2 = 1 as last, s.hash as sibling
            from placed p join lower_tree o on o.tree = p.tree and o.n > 1 and o.pos = p.pos >> o.level
            left join lower_tree s on s.tree = o.tree and s.level = o.level and s.pos = xor(o.pos, 1)
            union all
            select p.tree, p.pos, 100 + o.level, o.pos % 2 = 1, s.hash
            from placed p join upper_tree o on o.n > 1 and o.pos = p.tree >> o.level
            left join upper_tree s on s.level = o.level and s.pos = xor(o.pos, 1)
        ), steps as (
            select *, row_number() over (partition by tree, pos order by level) as step from above
        ), proofs as (
            select tree, pos, string_agg(sibling, '' order by step) as siblings from steps group by tree, pos
        ), folds as (
            select tree, pos, found as hash, 0 as step from placed
            union all
            select f.tree, f.pos, sha256(case when last then s.sibling || f.hash else f.hash || coalesce(s.sibling, '') end),
                f.step + 1
            from folds f join steps s on s.tree = f.tree and s.pos = f.pos and s.step = f.step + 1
        ), folded as (
            select tree, pos, arg_max(hash, step) as folded_root from folds group by tree, pos
        )
        select doc_id, p.hash as leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, folded_root,
            folded_root = root as verified
        from placed p join subroots using (tree) cross join (select hash as root from upper_tree where n = 1)
        join folded f on f.tree = p.tree and f.pos = p.pos left join proofs q on q.tree = p.tree and q.pos = p.pos
    """,
    "op13_decontamination": f"""
        with item_words as (
            select item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark
        ), windows as (
            select distinct item_id, least(len(ws), 10) as size,
                array_to_string(ws[pos:pos + least(len(ws), 10) - 1], ' ') as gram
            from (select *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as pos from item_words where len(ws) > 0)
        ), docs as (
            select row_number() over () as row, doc_id,
                coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as ws
            from documents
        ), places as (
            select row, pos, size, array_to_string(ws[pos:pos + size - 1], ' ') as gram
            from (select *, unnest(range(1, len(ws) + 1)) as pos from docs), (select distinct size from windows)
            where pos + size - 1 <= len(ws)
        ), hits as (
            select row, pos, p.size, item_id from places p join windows w on p.size = w.size and p.gram = w.gram
        ), hit_words as (
            select row, count(distinct word) as n_hit
            from (select row, unnest(range(pos, pos + size)) as word from hits) group by row
        ), hit_items as (
            select row, count(distinct item_id) as n_items,
                string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as listed
            from hits group by row
        )
        select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
            sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs d left join hit_words h on d.row = h.row left join hit_items i on d.row = i.row
    """,
}
