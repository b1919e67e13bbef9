"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"

#: CRC-32 (polynomial 0xEDB88320, reflected): the table of 256 remainders, and the remainder of a list of bytes.
CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b::bigint))"


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text column beside a column `tbl` that holds CRC_TABLE."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr({digits}, (2 * i + 1)::integer, 2))::bigint)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
        with iw as (select cast(item_id as varchar) item_id, regexp_extract_all({LOWER}, '{_ALNUM}') ws from benchmark),
             win as (select distinct item_id, least(len(ws), 10) n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') w
                     from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i from iw where len(ws) > 0)),
             dw as (select doc_id, row_number() over () rid, regexp_extract_all({LOWER}, '{_ALNUM}') ws from documents),
             ln as (select distinct n from win),
             dwin as (select rid, n, i, array_to_string(ws[i : i + n - 1], ' ') w
                      from (select rid, n, ws, unnest(range(1, len(ws) - n + 2)) i from dw, ln where len(ws) >= n)),
             hit as (select rid, d.n, i, w from dwin d semi join win using (n, w)),
             nh as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from hit) group by rid),
             ni as (select rid, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
                    from (select distinct rid, item_id from hit join win using (n, w)) group by rid)
        select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
               sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from dw left join nh using (rid) left join ni using (rid)
    """,
    "op3_mixing": f"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}'))::bigint size,
                          ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15))::bigint h from documents),
             s as (select source, sum(size)::bigint source_size from d group by source),
             w as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] w from s),
             c as (select *, source_size * 2 cap, source_size * 2.0::double / w r from w),
             l as (select *, ((sum(source_size) over ())::bigint * 1.5::double
                       - coalesce(sum(cap) over (order by r, source nulls first rows between unbounded preceding and 1 preceding), 0)::bigint)
                     / (sum(w) over () - coalesce(sum(w) over (order by r, source nulls first rows between unbounded preceding and 1 preceding), 0))::bigint lev from c),
             t as (select source, source_size, least(cap::double, (max(lev) over ()) * w) target from l),
             b as (select *, case when source_size > 0 then least(floor(target / source_size), 1) else 0 end::integer base from t),
             u as (select source, h, sum(size)::bigint words from d group by source, h),
             x as (select source, h, words, sum(words) over (partition by source order by h)::bigint upto from u)
        select d.doc_id, d.size, b.source_size, b.target,
               (d.size * (b.base + case when x.upto * 2 - x.words <= (b.target - b.base * b.source_size) * 2 then 1 else 0 end))::bigint taken
        from d join b on d.source is not distinct from b.source join x on x.source is not distinct from d.source and x.h = d.h
    """,
    "op6_jaccard_join": f"""
        with recursive d as (select doc_id, regexp_extract_all({LOWER}, '{_SPACE}') ws from documents),
             s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') g
                   from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i from d where len(ws) > 0)),
             n as (select doc_id, count(*) n from s group by doc_id),
             o as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
             link as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
             reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join link l on r.b = l.a),
             c as (select a doc_id, min(b) component_id, count(*) group_size from reach group by a)
        select doc_id, coalesce(n, 0) n_shingles, component_id, group_size from c left join n using (doc_id)
    """,
    "op9_exact_dedup": f"""
        with t as (select doc_id, sha256({LOWER}) as text_sha256 from documents),
             g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256
        from t join g using (text_sha256)
    """,
    "op11_sharding": f"""
        with recursive d as (select doc_id, strlen(t) + 8 size, {crc32("t")} text_crc32, md5(t) hash, ('0x' || substr(md5(t), 1, 4))::integer >> 2 unit
                             from (select doc_id, coalesce(text, '') t from documents), (select {CRC_TABLE} tbl)),
             g as (select hash, row_number() over (order by size desc, hash) - 1 j, size, sum(size) over () - sum(size) over (order by size desc, hash) + size rest
                   from (select hash, sum(size) size from d group by hash)),
             hot as (select hash, j from g where j <= 22 and size * (24 - j) >= rest),
             r as (select d.* replace (coalesce(-1 - j, unit)::integer as unit) from d left join hot using (hash)),
             l as (select list({{'unit': unit, 'size': size}} order by unit) u, sum(size)::bigint total, max(size) most, 24 - (select count(*) from hot) m
                   from (select unit, sum(size)::bigint size from r where unit >= 0 group by unit)),
             s as (select greatest(ceil(total / m)::bigint, most) - 1 lo, ceil(total / m)::bigint + most hi from l
                   union all select case when n <= m then lo else mid end, case when n <= m then mid else hi end
                   from (select lo, hi, mid, m, list_reduce(u, lambda s, x: case when s.load + x.size <= mid then {{'n': s.n, 'load': s.load + x.size}}
                                                                                   else {{'n': s.n + 1, 'load': x.size}} end, {{'n': 1, 'load': 0::bigint}}).n n
                         from (select *, (lo + hi) // 2 mid from s where hi - lo > 1), l)),
             c as (select u, total, m, (select min(hi) from s) capacity from l),
             b as (select *, list_reduce(list_reverse(u), lambda s, x: case when s.load + x.size <= capacity then {{'cuts': s.cuts, 'load': s.load + x.size, 'last': x.unit}}
                                           else {{'cuts': list_append(s.cuts, s.last), 'load': x.size, 'last': x.unit}} end, {{'cuts': []::integer[], 'load': 0::bigint, 'last': 0}}).cuts back from c),
             f as (select list_reduce(u, lambda s, x: case when s.load + x.size > capacity
                                             or (len(s.cuts) < m - 1 and x.unit >= coalesce(back[m - 1 - len(s.cuts)], -1) and (s.load + x.size / 2) * (m - len(s.cuts)) > s.rest and s.load > 0)
                                         then {{'cuts': list_append(s.cuts, x.unit), 'load': x.size, 'rest': s.rest - s.load}}
                                         else {{'cuts': s.cuts, 'load': s.load + x.size, 'rest': s.rest}} end, {{'cuts': []::integer[], 'load': 0::bigint, 'rest': total}}).cuts cuts from b),
             p as (select unit, ceil(count(*) * 16384 / sum(count(*)) over ())::bigint parts from r group by unit),
             q as (select r.*, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % parts part,
                          case when unit < 0 then -1 - unit else 24 - (select m from l) + len(list_filter((select cuts from f), lambda c: c <= unit)) end::integer shard from r join p using (unit))
        select doc_id, size, text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by unit, part, hash, doc_id nulls first) - 1 slot, null::integer grown_shard from q
    """,
    "op12_importance_resampling": f"""
        with dw as (select row_number() over () rid, doc_id, regexp_extract_all({LOWER}, '{_ALNUM}') ws from documents),
             du as (select rid, unnest(ws) w from dw),
             tu as (select unnest(regexp_extract_all({LOWER}, '{_ALNUM}')) w from benchmark),
             v as (select distinct w from (select w from du union all select w from tu)),
             b as (select w, {crc32("w")} % 10000 b from v, (select {CRC_TABLE} tbl)),
             sc as (select b, count(*) s from du join b using (w) group by b),
             tc as (select b, count(*) t from tu join b using (w) group by b),
             g as (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from du) + 10000)
                                / ((coalesce(s, 0) + 1)::double * ((select count(*) from tu) + 10000))))::bigint gain
                   from sc full join tc using (b)),
             m as (select rid, floor(sum(gain)::double / count(*))::bigint weight from du join b using (w) join g using (b) group by rid),
             c as (select rid, doc_id, len(ws)::bigint n_features, coalesce(weight, 0) weight,
                          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
                   from dw left join m using (rid)),
             r as (select rid, row_number() over (order by score desc, doc_id) place, count(*) over () n from c where n_features >= 20)
        select doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end::bigint as rank
        from c left join r using (rid)
    """,
}
