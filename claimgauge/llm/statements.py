"""The queries that SQL can express, as statements for DuckDB."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _then(answer: str, cost: int | str, letters: str) -> str:
    """An answer (cost, audit), if there is one, with more edits."""
    return f"case when {answer} is not null then {{'c': {answer}.c + {cost}, 'a': {answer}.a || '{letters}'}} end"


def _least(*answers: str) -> str:
    return f"list_min([{', '.join(answers)}])"


def conversation_repair() -> str:
    """By rows in order: the best (cost, audit) of each state, after what may be inserted before the
    row (b0..b3: nothing kept, after s, after u, after a), and after the row (s0..s3)."""
    keeps = {1: ("s", ("b0",)), 2: ("u", ("b0", "b1", "b3")), 3: ("a", ("b2",))}
    after = {0: [_then("b0", 4, "D")]}
    for state, (initial, before) in keeps.items():
        after[state] = [_then(f"b{state}", 4, "D")]
        for b in before:
            after[state].append(f"case when kind = '{initial}' then {_then(b, 'fault', 'K')} end")
            if initial != "s":
                after[state].append(
                    f"case when kind <> 'x' and kind <> '{initial}' then {_then(b, 'fault + 3', 'R')} end")
    steps = ", ".join(f"{_least(*answers)} as s{state}" for state, answers in after.items())
    return rf"""
with recursive bits(n, v, k) as (
    select range, range, 0 from range(256)
    union all
    select n, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8
),
lookup as (select list(v order by n) as t from bits where k = 8),
keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
    from conversations
),
kinds as (
    select conv_id, turn, role, text, xor(list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
    from keyed, lookup
),
damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
           case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
           unnest(range(case when kind = 3 then 2 else 1 end)) as copy
    from kinds where kind <> 0
),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from damaged
),
faults as (
    select conv_id, turn, role, text, i, substr(role, 1, 1) as initial,
           case when not regexp_matches(text, '{_WORD}') then 'blank'
                when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                when regexp_extract(text, '({_WORD})[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 'truncated'
                else '' end as fault,
           lag(substr(role, 1, 1)) over (partition by conv_id order by i) as earlier
    from placed
),
symbols as (
    select conv_id, i, case when fault in ('blank', 'duplicate') then 'x' when initial in ('s', 'u', 'a') then initial else 'o' end as kind,
           case when fault = 'truncated' then 3 else 0 end as fault
    from faults
),
solved(conv_id, i, s0, s1, s2, s3) as (
    select distinct conv_id, 0::bigint, {{'c': 0, 'a': ''}}, null::struct(c integer, a varchar),
           null::struct(c integer, a varchar), null::struct(c integer, a varchar)
    from conversations
    union all
    select conv_id, i, {steps}
    from (
        select d.conv_id, y.i, y.kind, y.fault, s0 as b0, s1 as b1,
               {_least("s2", _then("s0", 3, "I"), _then("s1", 3, "I"), _then("s3", 3, "I"))} as b2,
               {_least("s3", _then("s0", 6, "II"), _then("s1", 6, "II"), _then("s2", 3, "I"))} as b3
        from solved d join symbols y on d.conv_id is not distinct from y.conv_id and y.i = d.i + 1
    )
),
answers as (
    select conv_id, unnest({_least("s0", _then("s1", 6, "II"), _then("s2", 3, "I"), "s3")})
    from (select *, row_number() over (partition by conv_id order by i desc) as back from solved) where back = 1
),
letters as (
    select conv_id, p, substr(a, p, 1) as letter from (select conv_id, a, unnest(range(1, length(a) + 1)) as p from answers)
),
edits as (
    select conv_id, p, letter, sum(case when letter <> 'I' then 1 else 0 end) over (partition by conv_id order by p) as i
    from letters
),
emitted as (
    select e.conv_id, letter, role, text, initial, row_number() over (partition by e.conv_id order by p) as place
    from edits e left join faults f on e.conv_id is not distinct from f.conv_id and e.i = f.i and letter <> 'I'
    where letter <> 'D'
),
lines as (
    select conv_id, place, case
        when letter = 'K' then role
        when (place - max(case when place = 1 and letter = 'K' and initial = 's' then 1 else 0 end)
              over (partition by conv_id)) % 2 = 1 then 'user' else 'assistant' end
        || ':' || case when letter = 'I' then '' else text end as line
    from emitted
),
texts as (select conv_id, string_agg(line, chr(10) order by place) as whole from lines group by conv_id),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
           count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
           count(*) filter (fault = 'truncated') as truncated,
           count(*) filter (earlier is not null and earlier || initial not in ('su', 'ua', 'au')) as illegal
    from faults group by conv_id
)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, c::bigint as cost, a as audit,
       sha256(coalesce(whole, '')) as repaired_sha256
from answers a left join counts k on a.conv_id is not distinct from k.conv_id
left join texts t on a.conv_id is not distinct from t.conv_id
"""


def word_repeats(length: int = 13) -> str:
    return rf"""
with split as (
    select row_number() over () as row_no, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w from documents
),
windows as (
    select row_no, doc_id, p, array_to_string(w[p:p + {length - 1}], ' ') as win
    from (select row_no, doc_id, w, unnest(range(1, len(w) - {length - 2})) as p from split)
),
least as (select win, min(doc_id) as low from windows group by win),
gone as (
    select row_no, list(distinct q) as places
    from (select row_no, unnest(range(p, p + {length})) as q from windows join least using (win) where low < doc_id)
    group by row_no
)
select doc_id, len(w)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: places is null or not list_contains(places, i)), ' '), ''))
       as kept_sha256
from split left join gone using (row_no)
"""


def ranked_search(top: int = 50) -> str:
    return rf"""
with sized as (
    select row_no, doc_id, t, len(t) as n
    from (select row_number() over () as row_no, doc_id, {_TERMS} as t from documents) where len(t) > 0
),
whole as (select count(*) as docs, sum(n) as total from sized),
tf as (
    select row_no, doc_id, n, term, count(*) as tf
    from (select row_no, doc_id, n, unnest(t) as term from sized) group by row_no, doc_id, n, term
),
df as (select term, count(*) as df from tf group by term),
items as (
    select distinct item, item_id, term
    from (select row_number() over () as item, item_id, unnest({_TERMS}) as term from benchmark)
),
scored as (
    select item, item_id, row_no, doc_id, sum(
        floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint
        * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) as score
    from items join tf using (term) join df using (term), whole
    group by item, item_id, row_no, doc_id
)
select item_id, rank, doc_id, score::bigint as score
from (select *, row_number() over (partition by item order by score desc, doc_id nulls first) as rank
      from scored where score > 0)
where rank <= {top}
"""
