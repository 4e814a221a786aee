"""DuckDB SQL for the operators that SQL can express, written independently of
the Spark code."""

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
with d as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{WORD}')) as ls
  from documents),
word as (
  select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
win as (
  select doc_id, i, concat_ws(' ', x, lead(x, 1) over o, lead(x, 2) over o, lead(x, 3) over o,
         lead(x, 4) over o, lead(x, 5) over o, lead(x, 6) over o, lead(x, 7) over o) as g,
         lead(x, 7) over o as last_word
  from word window o as (partition by doc_id order by i)),
twice as (
  select doc_id, i from (
    select doc_id, i, count(*) over (partition by doc_id, g) as c from win
    where last_word is not null) where c > 1),
rep as (
  select doc_id, count(distinct p) as n
  from (select doc_id, unnest(range(i, i + 8)) as p from twice) group by doc_id),
m as (
  select d.doc_id, len(w) as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
         len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
         coalesce(rep.n, 0) as n_repeat_words,
         len(regexp_extract_all(t, '[A-Z]')) as up, len(regexp_extract_all(t, '[a-z]')) as lo
  from d left join rep on rep.doc_id = d.doc_id),
b as (
  select *,
    (case when n_words < 20 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
    + (case when 100 * n_symbols > 20 * n_words then 4 else 0 end)
    + (case when word_chars < 2 * n_words then 8 else 0 end)
    + (case when word_chars > 15 * n_words then 16 else 0 end)
    + (case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 32 else 0 end)
    + (case when 100 * up > 60 * (up + lo) then 64 else 0 end) as bits
  from m)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       (bits & 3) <> 0 as base_failed, bits = 0 as kept, bits::bigint as fail_bits
from b
"""


def licenses(templates: dict[str, str], percent: int) -> str:
    """Dice over word bigrams of every unit with every template, unpruned."""
    rows = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in templates.items())

    def norm(x: str) -> str:
        return (rf"string_split(trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                rf"'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')), ' ')")

    def pairs(x: str) -> str:
        return (f"list_distinct(list_transform(range(1, len({x})), "
                f"lambda i: {x}[i] || ' ' || {x}[i + 1]))")

    return rf"""
with tw as (select id, {norm('notice')} as w from (values {rows}) as v(id, notice)),
t as (select id, unnest({pairs('w')}) as g, len({pairs('w')}) as n from tw),
u as (
  select doc_id, row_number() over () as unit, {norm('unit')} as w from (
    select doc_id, unnest(list_distinct(list_concat(list_concat(string_split(text, chr(10)),
           string_split_regex(text, '\n[ \t\r]*\n')), [text]))) as unit
    from documents where text is not null)),
up as (select doc_id, unit, {pairs('w')} as gs from u),
ug as (select doc_id, unit, len(gs) as n, unnest(gs) as g from up),
hit as (
  select doc_id, unit, id, 2.0::double * count(*) / (any_value(ug.n) + any_value(t.n)) as dice
  from ug join t using (g) group by doc_id, unit, id
  having 200 * count(*) >= {percent} * (any_value(ug.n) + any_value(t.n))),
best as (
  select doc_id, count(*) as n_matches, string_agg(distinct id, ',' order by id) as licenses,
         first(id order by dice desc, id) as license, max(dice) as dice
  from hit group by doc_id)
select d.doc_id, license, dice, coalesce(n_matches, 0)::bigint as n_matches,
       coalesce(licenses, '') as licenses
from documents d left join best on best.doc_id = d.doc_id
"""


WARC = """
with p as (
  select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages),
f as (
  select sha256(body) as digest, min(page_id) as first_id from p where n >= 100 group by body)
select p.page_id, p.n::bigint as payload_bytes, sha256(p.body) as payload_digest,
       case when first_id <> p.page_id then 'revisit' else 'response' end as record_type,
       case when first_id <> p.page_id then first_id end as refers_to
from p left join f on f.digest = sha256(p.body)
"""


_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DECONTAMINATE = rf"""
with iw as (
  select item_id::varchar as item, w from (
    select item_id, regexp_extract_all(translate(text, {_AZ}), '{_PLAIN}') as w
    from benchmark where text is not null) where len(w) > 0),
ph as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from iw)),
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_PLAIN}') as w from documents),
word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
win10 as (
  select doc_id, i, concat_ws(' ', x, lead(x, 1) over o, lead(x, 2) over o, lead(x, 3) over o,
         lead(x, 4) over o, lead(x, 5) over o, lead(x, 6) over o, lead(x, 7) over o,
         lead(x, 8) over o, lead(x, 9) over o) as g
  from word window o as (partition by doc_id order by i)),
occ as (
  select win10.doc_id, win10.i, ph.item, ph.n from win10 join ph on ph.n = 10 and ph.g = win10.g
  union all
  select w.doc_id, w.i, p.item, p.n
  from (select item, n, g, string_split(g, ' ')[1] as x from ph where n < 10) p
  join word w on w.x = p.x join d on d.doc_id = w.doc_id
  where array_to_string(d.w[w.i:w.i + p.n - 1], ' ') = p.g),
hit as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
it as (
  select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items
  from occ group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on hit.doc_id = d.doc_id left join it on it.doc_id = d.doc_id
"""


_LEADS = ", ".join(f"lead(x, {i}) over o" for i in range(1, 20))

SUBSTRING = rf"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
win as (
  select doc_id, i, concat_ws(' ', x, {_LEADS}) as g, lead(x, 19) over o as last_word
  from word window o as (partition by doc_id order by i)),
late as (
  select doc_id, i from (
    select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from win
    where last_word is not null) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from late),
kept as (
  select word.doc_id, string_agg(x, ' ' order by word.i) as t, count(*) as n
  from word anti join gone on gone.doc_id = word.doc_id and gone.i = word.i group by word.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""


LEXICAL = rf"""
with qt as (
  select item_id, t, count(*) as c from (
    select item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '{_PLAIN}')) as t
    from benchmark where text is not null) group by item_id, t),
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_PLAIN}') as w from documents),
tot as (
  select count(*) filter (len(w) > 0) as n_docs, sum(len(w))::bigint as n_terms from d),
tf as (
  select doc_id, t, count(*) as tf from (select doc_id, unnest(w) as t from d)
  where t in (select t from qt) group by doc_id, t),
weight as (
  select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w
  from (select t, count(*) as df from tf group by t), tot),
len as (
  select doc_id, 100 - 75 + ((75 * len(w)::bigint * n_docs) // n_terms) as m from d, tot where len(w) > 0),
score as (
  select item_id, tf.doc_id,
         sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from tf join len on len.doc_id = tf.doc_id join weight on weight.t = tf.t join qt on qt.t = tf.t
  group by item_id, tf.doc_id),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank
  from score where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


# Damage and repair of conversations.  crc32 by its table; the costs behind each
# (row, state) from the last row up, then the walk that takes the cheapest edit, of
# equal ones the least letter (none, where the conversation may end, before any).
_STATES = ((0, 2), (1, 2), (2, 3), (3, 2))  # start, after system, user, assistant; the next role


def _least(x: int, y: int) -> str:
    """Cost of state x before a row, without insertions, by the costs after it."""
    keep = f"case when who = {y} then 0 else 3 end"
    system = ", case when who = 1 and fault < 2 then v1 + extra end" if x == 0 else ""
    return f"least(v{x} + 4, case when fault < 2 then v{y} + extra + {keep} end{system})"


_BACK = ", ".join(f"{_least(x, y)} as b{x}" for x, y in _STATES)
_IN = ", ".join(f"least(b{x}, b{y} + 3, b{dict(_STATES)[y]} + 6) as v{x}" for x, y in _STATES)
_NEXT = "case x when 0 then 2 when 1 then 2 when 2 then 3 else 2 end"


def _at(prefix: str, state: str) -> str:
    return f"case {state} when 0 then {prefix}0 when 1 then {prefix}1 when 2 then {prefix}2 else {prefix}3 end"


CONVERSATIONS = rf"""
with recursive tab as materialized (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) r(i))),
hit as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce(list_prepend(4294967295::bigint, [ord(ch)::bigint for ch in string_split(
               coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')]),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as hit
  from conversations, tab),
damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role,
         case when hit = 1 then '' when hit = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when hit = 0 then [] when hit = 3 then [0, 1] else [0] end) as copy from hit)),
numbered as (
  select *, row_number() over (partition by conv_id, role, text order by i) as nth,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') as said
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i
        from damaged)),
rows_ as materialized (
  select *, case left(role, 1) when 's' then 1 when 'u' then 2 when 'a' then 3 else 0 end as who,
         case when said = '' then 3 when nth > 1 then 2 when right(said, 1) not in ('.', '!', '?') then 1
              else 0 end as fault,
         case when said <> '' and nth = 1 and right(said, 1) not in ('.', '!', '?') then 3 else 0 end as extra
  from numbered),
size as materialized (select conv_id, count(*) as n from rows_ group by conv_id),
back as (
  select conv_id, n as i, 0 as v0, 6 as v1, 3 as v2, 0 as v3 from size
  union all
  select conv_id, i - 1 as i, {_IN} from (
    select back.conv_id, back.i, {_BACK}
    from back join rows_ on rows_.conv_id is not distinct from back.conv_id and rows_.i = back.i)),
cost as materialized (select * from back),
walk as (
  select size.conv_id, 0::bigint as i, 0 as x, '' as audit, [] :: varchar[] as lines, 0 as ended from size
  union all
  select conv_id, case when pick in ('I', '') then i else i + 1 end as i,
         case when pick in ('D', '') then x when pick = 'K' and who = 1 then 1 else y end as x,
         audit || pick as audit,
         case when pick in ('D', '') then lines
              else list_append(lines, case when pick = 'K' then role else full_role end || ':'
                                      || case when pick = 'I' then '' else text end) end as lines,
         case when pick = '' then 1 else 0 end as ended
  from (
    select *, case when y = 2 then 'user' else 'assistant' end as full_role,
           case when i = n and x in (0, 3) then ''
                when i < n and least_cost = d + 4 then 'D'
                when least_cost = own + 3 then 'I'
                when fault < 2 and ((who = y and least_cost = after_y + extra)
                     or (x = 0 and who = 1 and least_cost = after_s + extra)) then 'K'
                else 'R' end as pick
    from (
      select walk.conv_id, walk.i, walk.x, walk.audit, walk.lines, size.n, rows_.role, rows_.text,
             rows_.who, rows_.fault, rows_.extra, {_NEXT} as y,
             {_at('here.v', 'walk.x')} as least_cost, {_at('here.v', _NEXT)} as own,
             {_at('after_.v', 'walk.x')} as d, {_at('after_.v', _NEXT)} as after_y, after_.v1 as after_s
      from walk join size on size.conv_id is not distinct from walk.conv_id
      join cost here on here.conv_id is not distinct from walk.conv_id and here.i = walk.i
      left join cost after_ on after_.conv_id is not distinct from walk.conv_id and after_.i = walk.i + 1
      left join rows_ on rows_.conv_id is not distinct from walk.conv_id and rows_.i = walk.i + 1
      where walk.ended = 0))),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where fault = 3) as blank, count(*) filter (where fault = 2) as duplicate,
         count(*) filter (where fault = 1) as truncated,
         count(*) filter (where before is not null and left(before, 1) || left(role, 1)
                          not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(role) over (partition by conv_id order by i) as before from rows_) group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
       coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(cost.v0, 0)::bigint as cost,
       coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counts on counts.conv_id is not distinct from c.conv_id
left join cost on cost.conv_id is not distinct from c.conv_id and cost.i = 0
left join walk on walk.conv_id is not distinct from c.conv_id and walk.ended = 1
"""
