"""Check SQL, in DuckDB's dialect, for the operators that SQL can express."""

from __future__ import annotations

from shelfscope.llm import linerules, sharding, urlrules

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(map(_text, values))


def line_rules() -> str:
    phrases = _text("(?i)(" + "|".join(p.replace(" ", "[ ]") for p in linerules.BOILERPLATE) + ")")
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, {_WORDS}) as ws from d),
base as (
  select doc_id, len(ws) as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols
  from w),
windows as (
  select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from windows)
  where n > 1),
covered as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
    unnest(range(len(string_split(text, chr(10))))) as pos from d),
worded as (
  select doc_id, line, pos, regexp_extract_all(line, {_WORDS}) as ws from lines
  where regexp_matches(line, {_WORDS})),
marks as (
  select *, right(array_to_string(ws, ' '), 1) in ({_list(tuple(sorted(linerules.ENDINGS)))}) as mark,
    regexp_matches(ws[1], '^[\\p{{Ll}}\\p{{Lo}}]') as lower from worded),
-- a run: lines without an end mark and the line that they lead to
runs as (
  select *, sum(case when before and not before_mark and lower then 0 else 1 end)
    over (partition by doc_id order by pos) as run
  from (
    select *, lag(pos) over w = pos - 1 as before, lag(mark) over w as before_mark
    from marks window w as (partition by doc_id order by pos))),
own as (select *, bool_or(mark) over (partition by doc_id, run) as ended from runs),
marked as (
  select doc_id, length(array_to_string(ws, '')) as chars, len(ws) as n,
    row_number() over (partition by doc_id, line order by pos) > 1 as dup,
    len(list_filter(ws, lambda x: x in ({_list(linerules.SEPARATORS)}))) as bars,
    regexp_matches(line, {phrases}) as boilerplate,
    not ended as open_end,
    len(list_filter(ws, lambda x: regexp_matches(x, '([!?][!?]|[#*$%&|<>])$'))) as odd
  from own),
judged as (
  select doc_id, chars, dup,
    (bars >= 2 and bars * 5 >= n) or boilerplate or open_end or odd * 4 > n as failed from marked),
sums as (
  select doc_id, count(*) as n_lines, count(*) filter (dup) as n_dup_lines,
    count(*) filter (failed) as n_failed_lines, coalesce(sum(chars) filter (failed), 0) as lost_chars
  from judged group by doc_id),
counted as (
  select b.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    coalesce(n_failed_lines, 0) as n_failed_lines, cast(coalesce(lost_chars, 0) as bigint) as lost_chars
  from base b left join sums s on s.doc_id = b.doc_id left join covered c on c.doc_id = b.doc_id)
select *, n_words < {linerules.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < {linerules.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words)
    and lost_chars <= {linerules.MAX_LOST} * word_chars as kept
from counted
"""


def benchmark_decontamination() -> str:
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    shingle = "array_to_string([ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]], ' ')"
    return f"""
with iw as (select item_id, {words.format('text')} as ws from benchmark),
dw as (select doc_id, {words.format('text')} as ws from documents),
items as (
  select distinct item_id, {shingle} as s
  from (select item_id, ws, unnest(range(1, len(ws) - 3)) as i from iw where len(ws) >= 5)),
held as (
  select distinct doc_id, {shingle} as s
  from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from dw where len(ws) >= 5)),
sizes as (select item_id, count(*) as n from items group by item_id),
shared as (
  select doc_id, item_id, count(*) as k from held join items using (s) group by doc_id, item_id)
select doc_id, item_id, cast(k as int) as n_shared, cast(n as int) as n_item,
  cast(k as double) / n as containment
from shared join sizes using (item_id) where 100 * k >= 80 * n
"""


def url_filters() -> str:
    rows = ", ".join(
        f"({_text(v)}, {_text(p)}, {_text(p.partition('/')[0])}, {_text('/' + p.partition('/')[2])})"
        for v, p in urlrules.PREFIXES
    )
    special = ", ".join(
        f"({_text(v)}, {_text(p)}, {_text('(?s)' + urlrules.expression(p))})" for v, p in urlrules.PATTERNS
    )
    return f"""
with rules(verdict, rule, h, p) as (values {rows}),
patterns(verdict, pattern, rx) as (values {special}),
u as (
  select page_id, row_number() over () as pos,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
first as (
  select pos, rule, verdict from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  qualify row_number() over (partition by pos order by length(rule) desc) = 1),
other as (
  select pos, pattern, verdict from u join patterns
    on regexp_matches(case when contains(pattern, '/') then host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else host end, rx)
  qualify row_number() over (partition by pos order by length(pattern) desc, pattern) = 1)
select page_id, host, path, f.rule,
  coalesce(f.verdict, o.verdict, 'allow') as verdict,
  case when f.rule is null then o.pattern end as pattern
from u left join first f on f.pos = u.pos left join other o on o.pos = u.pos
"""


def lookup_sharding() -> str:
    n = sharding.SHARDS
    size = sharding.prime_from(100 * n)
    number = f"cast('0x' || substr(md5({{}}), 1, {sharding.DIGITS}) as bigint)"
    name = "'shard-' || lpad(cast(i as varchar), 5, '0') || "
    return f"""
with recursive prefs as materialized (
  select i, {number.format(name + "'/offset'")} % {size} as o,
    {number.format(name + "'/step'")} % {size - 1} + 1 as st
  from range({n}) t(i)),
fill(turn, owner, slot) as (
  select 0, list_transform(range({size}), lambda x: -1), -1
  union all
  select turn + 1,
    list_concat(list_concat(owner[1:s], [turn % {n}]), owner[s + 2:]), s
  from (
    select turn, owner,
      list_filter(range({size}), lambda k: owner[(o + k * st) % {size} + 1] < 0)[1] as k, o, st,
      (o + k * st) % {size} as s
    from fill join prefs on i = turn % {n} where turn < {size})),
cells as (select slot, (turn - 1) % {n} as shard from fill where turn > 0),
docs as (
  select doc_id, {number.format("coalesce(cast(doc_id as varchar), 'null')")} % {size} as slot from documents)
select doc_id, cast(docs.slot as int) as slot, cast(shard as int) as shard
from docs join cells on docs.slot = cells.slot
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bit = "(case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    step = f"list_reduce(range(8), lambda c, x: {bit}, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint))"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295::bigint), 4294967295)"


def merkle_manifest(levels: int = 5) -> str:
    """``levels`` levels of 16: 16 ** levels leaves per source and as many sources."""
    field = "coalesce(strlen({0}) || ':' || {0}, '-')"
    known = [field.format(f"cast({c} as varchar)") for c in ("doc_id", "source", "lang", "n_chars")]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    whole = " || ".join([*known, field.format("text")])
    tampered = " || ".join([*known, field.format(lower)])
    parts = [f"""
with d as (
  select doc_id, source, sha256({whole}) as leaf,
    case when doc_id is not null and {_crc32("cast(doc_id as varchar)")} % 5 = 0 then sha256({tampered}) end as tampered
  from documents),
a0 as (
  select source as g, h, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i,
    doc_id, tampered
  from (select *, leaf as h from d))"""]
    # per tree: level k has nodes (g, i, h); a node's flanks are those of its run
    for t in "ab":
        if t == "b":
            parts.append(
                "b0 as (select 0 as g, h, row_number() over (order by g is not null, encode(g)) - 1 as i, g as own "
                f"from a{levels})"
            )
        for k in range(levels):
            parts.append(f"""
{t}{k}r as (
  select g, i // 16 as r, string_agg(h, '' order by i) as run, count(*) as n from {t}{k} group by g, i // 16),
{t}{k}n as (select g as g1, count(*) as total from {t}{k} group by g),
{t}{k + 1} as (
  select g, r as i, case when total > 1 then sha256(run) else run end as h
  from {t}{k}r join {t}{k}n on g is not distinct from g1)""")
    flank = (
        "case when {t}{k}n.total > 1 then [{{'l': substr({t}{k}r.run, 1, at{k} % 16 * 64), "
        "'r': substr({t}{k}r.run, at{k} % 16 * 64 + 65)}}] else [] end"
    )
    # the place of a leaf on each level, and the run that holds it
    for t, first in (("a", "a0"), ("b", "b0")):
        places = ", ".join(f"i // {16 ** k} as at{k}" for k in range(levels))
        joins = " ".join(
            f"join {t}{k}r on {t}{k}r.g is not distinct from x.g and {t}{k}r.r = at{k} // 16 "
            f"join {t}{k}n on {t}{k}n.g1 is not distinct from x.g"
            for k in range(levels)
        )
        path = " || ".join(flank.format(t=t, k=k) for k in range(levels))
        parts.append(f"{t}p as (select x.*, {path} as path from (select *, {places} from {first}) x {joins})")
    typed = "list_reduce(list_transform(path, lambda x: x.l || '|' || x.r), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), {0})"
    return ",".join(parts) + f""",
ends as (
  select ap.doc_id, ap.h as leaf, a{levels}.h as subroot, b{levels}.h as root, ap.tampered, ap.path || bp.path as path
  from ap join a{levels} on a{levels}.g is not distinct from ap.g join bp on bp.own is not distinct from ap.g
    cross join b{levels}),
folded as (
  select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) as proof_sha256,
    {typed.format("coalesce(tampered, leaf)")} as folded_root
  from ends)
select *, folded_root = root as verified from folded
"""


def conversation_repair() -> str:
    conv, turn = (f"coalesce(cast({c} as varchar), ' ')" for c in ("conv_id", "turn"))
    space = r"[\x20\x09-\x0D]"

    def best(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x is not null))"

    def plus(state: str, cost: str, letter: str, line: str) -> str:
        """A state (cost and edits as one text that sorts, and the lines written) one edit on."""
        return (
            f"case when {state} is not null then {{'k': lpad(cast(cast(substr({state}.k, 1, 9) as bigint) + {cost} as varchar), 9, '0') "
            f"|| substr({state}.k, 10) || '{letter}', 'r': {state}.r || {line}}} end"
        )

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def inserted(v: str) -> list[str]:
        """States after inserts at the end of a state."""
        to_u = [plus(f"{v}{i}", "2", "I", user) for i in (0, 1, 3)]
        to_a = plus(f"{v}2", "2", "I", assistant)
        twice = [plus(f"({plus(f'{v}{i}', '2', 'I', user)})", "2", "I", assistant) for i in (0, 1)]
        return [f"{v}0", f"{v}1", best(f"{v}2", *to_u), best(f"{v}3", to_a, *twice)]

    ins = ", ".join(f"{e} as w{j}" for j, e in enumerate(inserted("v")))
    m = "(case when fault = 'truncated' then 1 else 0 end)"
    free = "fault is null or fault = 'truncated'"
    kept, cut = "chr(10) || role || ':' || text", "chr(10) || '{}:' || text"

    def edits(j: int) -> str:
        out = [plus(f"w{j}", "3", "D", "''")]
        if j == 1:
            out.append(f"case when ({free}) and first = 's' then {plus('w0', m, 'K', kept)} end")
        if j > 1:
            name, froms = ("user", (0, 1, 3)) if j == 2 else ("assistant", (2,))
            for i in froms:
                out.append(f"case when ({free}) and first = '{name[0]}' then {plus(f'w{i}', m, 'K', kept)} end")
                out.append(f"case when {free} then {plus(f'w{i}', f'2 + {m}', 'R', cut.format(name))} end")
        return best(*out)

    steps = ", ".join(f"{edits(j)} as v{j}" for j in range(4))
    empty = "{'k': '000000000', 'r': ''}"
    none = "cast(null as struct(k varchar, r varchar))"
    return f"""
with recursive coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32(f"{conv} || ':' || {turn}")} % 20 as code
  from conversations),
damaged as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case code when 0 then 0 when 3 then 2 else 1 end)) as copy
  from coded),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i,
    left(role, 1) as first from damaged),
judged as materialized (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?]{space}*$') then 'truncated' end as fault,
    lag(first) over (partition by conv_id order by i) as previous from placed),
walk(conv_id, i, v0, v1, v2, v3) as (
  select conv_id, cast(0 as bigint), {empty}, {none}, {none}, {none} from (select distinct conv_id from placed)
  union all
  select conv_id, i, {steps}
  from (
    select j.conv_id, j.i, j.role, j.text, j.first, j.fault, {ins}
    from walk join judged j on j.conv_id is not distinct from walk.conv_id and j.i = walk.i + 1)),
ended as (
  select conv_id, {best("v0", "v3", plus("v2", "2", "I", assistant))} as w
  from walk qualify i = max(i) over (partition by conv_id)),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (previous is not null and previous || first not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cast(substr(w.k, 1, 9) as bigint), 0) as cost, coalesce(substr(w.k, 10), '') as audit,
  sha256(coalesce(substr(w.r, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
  left join counts c on c.conv_id is not distinct from o.conv_id
  left join ended e on e.conv_id is not distinct from o.conv_id
"""


def oracles() -> dict[str, str]:
    return {
        "op2_line_rules": line_rules(),
        "op8_benchmark_decontamination": benchmark_decontamination(),
        "op9_url_filters": url_filters(),
        "op10_lookup_sharding": lookup_sharding(),
        "op11_merkle_manifest": merkle_manifest(),
        "op13_conversation_repair": conversation_repair(),
    }
