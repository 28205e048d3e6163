"""DuckDB SQL with the results of the registered queries that SQL can express."""

_OP2 = r"""
with u as (select page_id, coalesce(url, '') url from pages),
r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from u),
p as (select page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from r),
rules(rule, rhost, rpath, blocks) as (values
  ('org/', 'org', '/', false), ('example.org/es/', 'example.org', '/es/', true),
  ('example.org/en/1', 'example.org', '/en/1', true), ('com/fr/', 'com', '/fr/', false), ('com/de/', 'com', '/de/', true)),
best as (select page_id, arg_max(rule, length(rule) * 2 + blocks::int) rule, arg_max(blocks, length(rule) * 2 + blocks::int) blocks
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select p.page_id, host, path, rule,
  case when rule is not null then case when blocks then 'block' else 'allow' end when ok then 'allow' else 'block' end verdict, ok usable
from (select *, host <> '' and not starts_with(host, '.') and not ends_with(host, '.') and not contains(host, '..') ok from p) p
left join best using (page_id)
"""

_OP7 = r"""
with d as (select doc_id, coalesce(text, '') t from documents),
k(kind, ord, pat) as (values
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  ('ip', 1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  ('card', 2, '[0-9]([\x20-]?[0-9])+'),
  ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')),
m as (select doc_id, kind, ord, t, regexp_extract_all(t, pat) ms from d, k where regexp_matches(t, pat)),
e as (select doc_id, kind, ord, t, ms, unnest(range(1, len(ms) + 1)) i from m),
b as (select doc_id, kind, ord, ms[i] s, i,
    -- the text between matches, from splitting at a character that no text holds
    list_transform(string_split(case kind when 'email' then regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', chr(1), 'g')
      when 'ip' then regexp_replace(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', chr(1), 'g')
      when 'card' then regexp_replace(t, '[0-9]([\x20-]?[0-9])+', chr(1), 'g')
      else regexp_replace(t, '\+[0-9][\x20().0-9-]+[0-9]', chr(1), 'g') end, chr(1)), lambda x: length(x)) gaps,
    list_transform(ms, lambda x: length(x)) lens from e
  where (kind <> 'card' or length(regexp_replace(ms[i], '[^0-9]', '', 'g')) between 14 and 19)
    and (kind <> 'phone' or length(regexp_replace(ms[i], '[^0-9]', '', 'g')) between 10 and 15)
    and (kind <> 'ip' or len(list_filter(string_split(ms[i], '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0)),
p as (select doc_id, kind, ord, s, cast(list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) as bigint) st,
    reverse(regexp_replace(s, '[^0-9]', '', 'g')) rd from b),
f as (select *, kind || ':' || st || ':' || (st + length(s)) item from p where kind <> 'card' or list_sum(list_transform(range(1, length(rd) + 1), lambda j:
      case when j % 2 = 1 then cast(rd[j] as int) when cast(rd[j] as int) > 4 then 2 * cast(rd[j] as int) - 9 else 2 * cast(rd[j] as int) end)) % 10 = 0),
a as (select doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip, count(*) filter (kind = 'card') n_card,
    count(*) filter (kind = 'phone') n_phone, string_agg(item, ',' order by st, ord) items from f group by doc_id)
select d.doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone,
  sha256(coalesce(items, '')) base_sha256 from d left join a using (doc_id)
""".replace("\\\\", "\\")

_OP9 = r"""
with recursive rows_ as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) n_tokens from documents),
totals as (select source, sum(n_tokens)::bigint total from rows_ group by source),
whole as (select sum(total)::bigint whole, count(*) n from totals where total > 0),
p as (select total / whole::double p from totals, whole where total > 0),
ext as (select max(p) / min(p) spread, max(p) largest from p),
target as (select 0.95 * ln(n) enough from whole),
h1 as (select -sum(p * ln(p)) h from p),
eb as (select 0 i, 0.0::double lo, 1.0::double hi
  union all
  select i + 1, case when h >= enough then mid else lo end, case when h >= enough then hi else mid end from (
    select i, lo, hi, mid, enough, ln(sum(pow(p, mid))) - mid * sum(pow(p, mid) * ln(p)) / sum(pow(p, mid)) h
    from (select i, lo, hi, (lo + hi) / 2 mid from eb where i < 40) b, p, target group by i, lo, hi, mid, enough)),
rb as (select 0 i, 0.0::double lo, 1.0::double hi
  union all
  select i + 1, case when pow(spread, 1 - mid) <= 2.0 then lo else mid end, case when pow(spread, 1 - mid) <= 2.0 then mid else hi end
  from (select i, lo, hi, (lo + hi) / 2 mid from rb where i < 40) b, ext),
a as (select round(greatest(case when h >= enough then 1.0 else (select lo from eb where i = 40) end,
    case when spread <= 2.0 then 0.0 else (select hi from rb where i = 40) end), 6) a from h1, target, ext),
z as (select sum(pow(p, a)) z from p, a),
w as (select source, total, case when total > 0 then round(pow(total / whole::double, a) / z * 1e6)::bigint else 0 end weight_ppm,
    total * case when total > 0 then round(pow(largest / (total / whole::double), 1 - a) * 10000)::bigint else 10000 end // 10000 planned
  from totals, whole, a, z, ext),
c as (select doc_id, r.source, n_tokens, total, weight_ppm, planned, unnest(range(0, case when total > 0 then (planned + total - 1) // total else 1 end)) epoch
  from rows_ r join w on r.source is not distinct from w.source),
k as (select *, coalesce(sum(n_tokens) over (partition by source, epoch order by md5('0:' || epoch || ':' || doc_id), doc_id
    rows between unbounded preceding and 1 preceding), 0) + epoch * total off from c),
b as (select *, case when total > 0 then cast(least(off * 64 // planned, 63) as int) else 0 end block from k where total = 0 or off < planned or (n_tokens = 0 and off = planned))
select doc_id, source, max(n_tokens)::bigint n_tokens, max(weight_ppm) weight_ppm, count(*) copies, string_agg(block::varchar, ',' order by block) blocks
from b group by doc_id, source
"""

_OP3 = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from words where len(w) > 0)),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
common as (select a.doc_id x, b.doc_id y, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id r from documents union select reach.doc_id, y from reach join both_ways on reach.r = x)
select d.doc_id, coalesce(max(n), 0) n_shingles, min(r) component_id, min(r) = d.doc_id kept
from documents d join reach using (doc_id) left join sizes using (doc_id) group by d.doc_id
"""

_OP10 = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
parts as (select doc_id, base, substr(h, 2 * base + 1, 1398) p from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 500)) base from d)),
w as (select doc_id, base + i i, md5(substr(p, 2 * i + 1, 400)) k from (select doc_id, base, p, unnest(range(0, least(500, length(p) // 2 - 199))) i from parts)),
f as (select doc_id, i from w where k in (select k from w group by k having count(*) > 1)),
g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end fresh from f),
runs as (select doc_id, min(i) a, max(i) + 200 b from (select *, sum(fresh) over (partition by doc_id order by i) run from g) group by doc_id, run),
gaps as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) from_, a to_ from runs
  union all select doc_id, max(b), (select length(h) // 2 from d where d.doc_id = runs.doc_id) from runs group by doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' order by from_) h from gaps join d using (doc_id) group by doc_id),
gone as (select doc_id, sum(b - a) n_removed, count(*) n_spans from runs group by doc_id)
select d.doc_id, length(d.h) // 2 n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept.h, d.h))) kept_sha256
from d left join kept using (doc_id) left join gone using (doc_id)
"""

_OP11 = r"""
with d as (select row_number() over () u, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts from documents),
q as (select row_number() over () v, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts from benchmark),
qt as (select v, item_id, term, count(*) c from (select v, item_id, unnest(ts) term from q) group by all),
dt as (select u, doc_id, n, term, count(*) tf from (select u, doc_id, len(ts) n, unnest(ts) term from d) group by all),
whole as (select count(*)::bigint docs, sum(len(ts))::bigint terms from d where len(ts) > 0),
w as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) w from dt, whole group by term, docs),
s as (select v, item_id, u, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) as bigint) score
  from dt join qt using (term) join w using (term), whole group by v, item_id, u, doc_id),
r as (select *, row_number() over (partition by v order by score desc, doc_id nulls last, u) rank from s where score > 0)
select item_id, rank::int rank, doc_id, score from r where rank <= 20
"""

_OP6_BASE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
p as (select doc_id, unnest(w) w, generate_subscripts(w, 1) - 1 i from d),
n as (select doc_id, i, w, lead(w) over o b, lead(w, 2) over o c from p window o as (partition by doc_id order by i)),
h as (select doc_id, i, case when w = 'cc' and b = 'by' then 'cc-by' when w = 'general' and b = 'public' and c = 'license' then 'gpl'
  when w = 'all' and b = 'rights' and c = 'reserved' then 'reserved' end label from n)
select d.doc_id, len(any_value(w)) n_words, count(label) n_base, min(i) first_word, max(i) last_word, coalesce(string_agg(distinct label, ',' order by label), '') base_labels
from d left join (select * from h where label is not null) h using (doc_id) group by d.doc_id
"""

_OP5_PAYLOAD = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
p as (select doc_id, length(h) // 2 n, greatest(1, (length(h) // 2 + 575) // 576) * 576 m, h from d),
f as (select doc_id, n, m, h || repeat('FF', m - n) payload, printf('%08X', m) a, printf('%08X', m + 36) b from p)
select doc_id, n n_bytes, m payload_bytes, sha256(unhex(payload)) payload_sha256, m + 44 media_bytes,
  sha256(unhex(hex(encode('RIFF')) || b[7:8] || b[5:6] || b[3:4] || b[1:2] || hex(encode('WAVEfmt ')) || '10000000' || '0100' || '0100'
    || '401F0000' || '401F0000' || '0100' || '0800' || hex(encode('data')) || a[7:8] || a[5:6] || a[3:4] || a[1:2] || payload)) media_sha256
from f
"""

SQL = {"license_base": _OP6_BASE, "media_payload": _OP5_PAYLOAD, "pii_base": _OP7, "op3_near_duplicates": _OP3, "op10_repeats": _OP10, "op11_ranked_search": _OP11, "op9_mixing": _OP9, "op2_url_filter": _OP2}
