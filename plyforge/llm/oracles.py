"""SQL of the pN_ queries that SQL can express."""

from __future__ import annotations

_STAGE = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^.*checkpoints/([^/]+)(/.*)?$', '\\1'), '-[0-9]{{8}}-[0-9]{{6}}$', ''), '[_ ]+', '-', 'g')"

_GAMES = f"""
with raw as (
  select match_id, game_index, {_STAGE.format("stage_a")} item_a, {_STAGE.format("stage_b")} item_b, a_white, score, recorded_at,
         regexp_replace(replace(replace(lower(trim(result)), '–', '-'), '—', '-'), '\\s*([-:/])\\s*', '\\1', 'g') r
  from match_games),
seen as (
  select *, case when r in ('1-0', '1:0', 'white wins', 'white') then 1.0
                 when r in ('1/2-1/2', '1/2', '½-½', '½', '0.5-0.5', 'draw') then 0.5
                 when r in ('0-1', '0:1', 'black wins', 'black') then 0.0 end white from raw),
two as (
  select *, case when white = 0.5 then 0.5 when a_white then white when not a_white then 1 - white end by_result,
         case when score in (0, 0.5, 1) then score end stated from seen),
good as (
  select match_id, game_index, item_a, item_b, recorded_at,
         case when r in ('*', 'unfinished', 'aborted') then null
              when by_result is not null and stated is not null and by_result <> stated then null
              else coalesce(by_result, stated) end score from two),
games_once as (
  select * from good where score is not null
  qualify row_number() over (partition by match_id, game_index order by recorded_at desc, item_a desc, item_b desc, score desc) = 1)
"""

_KEY = """
case when lower(trim(item_kind)) = 'puzzle' then nullif(regexp_replace(trim(item_key), '^(?:.*[/#])', ''), '')
     when try_cast(regexp_extract(trim(item_key), '^([+-]?[0-9]{1,20})(?:[.]0*)?$', 1) as decimal(21, 0)) > 9223372036854775807
     then cast(try_cast(regexp_extract(trim(item_key), '^([+-]?[0-9]{1,20})(?:[.]0*)?$', 1) as decimal(21, 0)) - 18446744073709551616 as varchar)
     else cast(try_cast(regexp_extract(trim(item_key), '^([+-]?[0-9]{1,20})(?:[.]0*)?$', 1) as decimal(21, 0)) as varchar) end
"""


#: Alternate scaling of the rows and columns of the smoothed matrix, to the same stop.
_STRENGTHS = f"""
with recursive {_GAMES.strip()[5:]},
cells as (
  select winner, loser, sum(w) wins from (
    select item_a winner, item_b loser, cast(score as double) w from games_once where item_a <> item_b
    union all select item_b, item_a, 1 - cast(score as double) from games_once where item_a <> item_b)
  where winner in (select stage from stages) and loser in (select stage from stages) group by all),
names as (select stage, row_number() over (order by stage) i from (select distinct stage from stages)),
met as (
  select a.i, b.i j, coalesce(wins, 0) w from names a cross join names b left join cells on winner = a.stage and loser = b.stage
  union all select i, 17, 0.05 from names union all select 17, i, 0.05 from names union all select 17, 17, 0),
own as (select i, sum(w) own from (select i, w from met union all select j, w from met) group by 1),
matrix as (select list(r order by i) m from (select met.i, list(w + if(met.i = j, own, 0) order by j) r from met join own using (i) group by 1)),
sweeps(k, o, d, moved) as (
  select 0, list_transform(range(17), lambda x: cast(1 as double)), list_transform(range(17), lambda x: cast(1 as double)), cast(1 as double)
  union all
  select k + 1, o2, d2, list_max(list_transform(range(1, 17), lambda x: ln(o2[x] / d2[x]) - ln(o[x] / d[x]))) - list_min(list_transform(range(1, 17), lambda x: ln(o2[x] / d2[x]) - ln(o[x] / d[x]))) from (
    select k, o, d, o2, list_transform(range(1, 18), lambda y: list_sum(list_transform(range(1, 18), lambda x: m[x][y] / o2[x]))) d2 from (
      select k, o, d, m, list_transform(range(1, 18), lambda x: list_sum(list_transform(range(1, 18), lambda y: m[x][y] / d[y]))) o2 from sweeps cross join matrix where moved > 1e-10 and k < 20000))),
rest as (select o, d, sqrt(exp(list_avg(list_transform(range(1, 17), lambda x: ln(o[x] / d[x]))))) level from sweeps order by k desc limit 1),
scaled as (select stage, o[i] / level offence, d[i] * level defence, o[i] / d[i] / level / level strength from rest cross join names),
played as (select stage, sum(wins) games from (select winner stage, wins from cells union all select loser, wins from cells) group by 1)
select cast(row_number() over (order by round(strength, 9) desc, stage) as integer) place, stage, round(strength, 4) strength, round(offence, 3) offence, round(defence, 3) defence, coalesce(games, 0) games
from scaled left join played using (stage)
"""


def _sample(table: str, key: str, num: int, den: int, salt: str) -> str:
    return f"""
    with first as (select {key}, min(batch_no) batch_no from {table} where {key} is not null group by 1),
    ranked as (select *, row_number() over (partition by batch_no order by md5('{salt}:' || {key}), {key}) rk, count(*) over (partition by batch_no) n from first)
    select {key}, batch_no from ranked where rk <= (n * {num} + {den} - 1) // {den}"""


_SPLIT = "case when lower(trim(split)) in ('train', 'training', 'trn', 'tr') then 'train' when lower(trim(split)) in ('val', 'valid', 'validation', 'dev') then 'val' when lower(trim(split)) in ('test', 'testing', 'tst', 'te') then 'test' end"

_REACH = """
with recursive ids as (
  select game_id, nullif(regexp_extract(trim(site), '^(?:[hH][tT][tT][pP][sS]?://)?(?:[wW]{3}[.])?[a-zA-Z0-9.-]+[.][a-zA-Z]+/(?:[gG][aA][mM][eE]/)?([0-9A-Za-z]{8})(?:[^0-9A-Za-z]|$)', 1), '') code,
         lower(regexp_replace(trim(white_name), '\\s+', ' ', 'g')) w, lower(regexp_replace(trim(black_name), '\\s+', ' ', 'g')) b,
         utc_date d, regexp_replace(trim(uci), '\\s+', ' ', 'g') m from games),
edges as (
  select distinct x.game_id a, y.game_id b from ids x join ids y on x.code = y.code and x.game_id <> y.game_id
  union select distinct x.game_id, y.game_id from ids x join ids y on x.w = y.w and x.b = y.b and x.d = y.d and x.m = y.m and x.game_id <> y.game_id and (x.code is null or y.code is null)),
reach(a, b) as (
  select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a)
"""

_TORN = _REACH + f""",
recs as (
  select distinct game_id, {_SPLIT} s from (select game_id, split from label_rows union all select game_id, split from puzzles) where game_id is not null and {_SPLIT} is not null),
roots as (select game_id, s, coalesce((select min(b) from reach where a = game_id), game_id) root from recs),
torn as (select root from roots group by root having count(distinct s) > 1)
select distinct game_id from roots where root in (select root from torn)
"""

_SPLITS = _REACH + """,
tied as (select a game_id, least(a, min(b)) root from reach group by a),
recs as (
  select 'label' kind, cast(label_id as varchar) record, game_id from label_rows
  union all select 'puzzle', puzzle_id, game_id from puzzles),
told as (select kind, record, min(game_id) told from recs where kind = 'puzzle' and game_id is not null group by all),
named as (
  select recs.kind, recs.record, recs.game_id, coalesce(tied.root, recs.game_id, told) root
  from (select recs.*, told, coalesce(game_id, told) id from recs left join told using (kind, record)) recs left join tied on tied.game_id = id
  where recs.game_id is not null or recs.record is not null),
units as (select *, coalesce(cast(root as varchar), kind || ':' || record) unit from named),
sizes as (select unit, count(*) size, cast(floor(log2(count(*))) as integer) band from units group by 1),
placed as (select *, row_number() over (order by band desc, md5('deal1:' || unit), unit) i from sizes),
dealt as (
  select *, case when (i + 5) // 10 > (i + 4) // 10 then 'test'
                 when (i - (i + 5) // 10 + 4) // 9 > (i - (i + 5) // 10 - 1 + 4) // 9 then 'val' else 'train' end split from placed)
select kind, record, game_id, root, size, band, split from units join dealt using (unit)
"""

_BOARD = "replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '8', '........', 'g'), '7', '.......', 'g'), '6', '......', 'g'), '5', '.....', 'g'), '4', '....', 'g'), '3', '...', 'g'), '2', '..', 'g'), '1', '.', 'g'), '/', '')"

_ROWS = f"""
with f as (
  select *, string_split(regexp_replace(trim(fen), '\\s+', ' ', 'g'), ' ') p,
         case when trim(line) <> '' then replace(regexp_replace(lower(trim(line)), '\\s+', ' ', 'g'), '=', '') end l from engine_lines),
g as (
  select *, p[1] place, lower(p[2]) turn, lower(coalesce(p[4], '-')) ep,
         coalesce(nullif(concat(case when contains(p[3], 'K') then 'K' else '' end, case when contains(p[3], 'Q') then 'Q' else '' end, case when contains(p[3], 'k') then 'k' else '' end, case when contains(p[3], 'q') then 'q' else '' end), ''), '-') rights,
         coalesce(nullif(regexp_replace(lower(trim(move)), '[=\\s-]', '', 'g'), ''), split_part(l, ' ', 1)) mv, {_BOARD.format("p[1]")} board from f),
h as (
  select * replace (case when turn = 'w' and mv = 'e1h1' and contains(rights, 'K') then 'e1g1' when turn = 'w' and mv = 'e1a1' and contains(rights, 'Q') then 'e1c1'
                         when turn = 'b' and mv = 'e8h8' and contains(rights, 'k') then 'e8g8' when turn = 'b' and mv = 'e8a8' and contains(rights, 'q') then 'e8c8' else mv end as mv), ascii(ep) - 97 x from g),
k as (
  -- the rank a capturing pawn stands on: the fifth for White (row 4 of the text), the fourth for Black (row 5)
  select *, case when ep similar to '[a-h][36]' and
      ((turn = 'w' and ((x > 0 and substr(board, 24 + x, 1) = 'P') or (x < 7 and substr(board, 24 + x + 2, 1) = 'P'))) or
       (turn = 'b' and ((x > 0 and substr(board, 32 + x, 1) = 'p') or (x < 7 and substr(board, 32 + x + 2, 1) = 'p')))) then ep else '-' end square from h),
r as (
  select *, count(*) over (partition by place, turn, rights, square, mv) n,
         (cp is not null or mate is not null) and depth between 1 and 245 able,
         row_number() over (partition by place, turn, rights, square, mv order by
           coalesce((cp is not null or mate is not null) and depth between 1 and 245, false) desc, depth desc nulls last, knodes desc nulls last, fetched_at desc nulls last, line_id) rk
  from k where mv is not null and mv <> '')
"""

_SURVIVORS = _ROWS + "select line_id from r where n > 1 and able and rk = 1"

_FILLED = _ROWS + """,
votes as (select place, turn, rights, square, mv, knodes, fetched_at, case when depth between 1 and 245 then cast(depth as bigint) * depth else 1 end v from r),
nodes as (select * from (select place, turn, rights, square, mv, knodes won_nodes, row_number() over (partition by place, turn, rights, square, mv order by sum(v) desc, knodes desc) o from votes where knodes is not null group by place, turn, rights, square, mv, knodes) where o = 1),
times as (select * from (select place, turn, rights, square, mv, fetched_at won_time, row_number() over (partition by place, turn, rights, square, mv order by sum(v) desc, fetched_at desc) o from votes where fetched_at is not null group by place, turn, rights, square, mv, fetched_at) where o = 1)
select line_id, n n_rows, depth, coalesce(knodes, won_nodes) knodes, cp, mate, strftime(coalesce(fetched_at, won_time), '%Y-%m-%d %H:%M:%S') fetched_at,
  concat_ws(' ', case when knodes is null and won_nodes is not null then 'knodes' end, case when fetched_at is null and won_time is not null then 'fetched_at' end) filled
from r left join nodes using (place, turn, rights, square, mv) left join times using (place, turn, rights, square, mv) where able and rk = 1
"""

_PHASE = "case when t in ('opening', 'openings', 'op') then 'opening' when t in ('middlegame', 'middle', 'mid', 'mg') then 'middlegame' when t in ('endgame', 'ending', 'end', 'eg') then 'endgame' end"

_TARGETS = f"""
with phases as (select distinct game_id, ply, {_PHASE} category from (select game_id, ply, regexp_replace(lower(phase), '[\\s_-]+', '', 'g') t from label_rows where game_id is not null and ply is not null)),
bands as (
  select distinct puzzle_id, case when regexp_matches(t, '^[0-9]+(-|–|—|_|to)[0-9]+$') then regexp_replace(t, '^([0-9]+)(-|–|—|_|to)([0-9]+)$', '\\1-\\3')
    when regexp_matches(t, '^[0-9]+([+]|plus)$') then regexp_extract(t, '^[0-9]+') || '+' when regexp_matches(t, '^(≥|>=)[0-9]+$') then regexp_extract(t, '[0-9]+$') || '+' end category
  from (select puzzle_id, regexp_replace(lower(band), '\\s+', '', 'g') t from puzzles where puzzle_id is not null)),
have as (select 'label_rows' base_table, category, count(*) n from phases where category is not null group by 2 union all select 'puzzles', category, count(*) from bands where category is not null group by 2)
select sample_name, category, greatest(min_records, cast(ceil(round(target_share * sample_size, 6)) as bigint)) needed, coalesce(n, 0) available,
       greatest(0, greatest(min_records, cast(ceil(round(target_share * sample_size, 6)) as bigint)) - coalesce(n, 0)) shortfall
from sample_targets left join have using (base_table, category)
"""

_MIX = """
with docs as (select doc_id, regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') source, length(text) tokens from documents where length(text) > 0),
summed as (select *, sum(tokens) over (partition by source order by md5('mix1:' || doc_id), doc_id rows unbounded preceding) upto, sum(tokens) over (partition by source) total from docs),
queue as (
  select mix_name, s.source, doc_id, pass, tokens, cast((pass - 1) * total + upto as double) / weight finish, budget_tokens
  from summed s join mix_targets t on s.source = t.source, lateral (select unnest(range(1, max_repeats + 1)) pass)),
taken as (select *, sum(tokens) over (partition by mix_name order by finish, source, pass, doc_id rows unbounded preceding) run from queue)
select mix_name, row_number() over (partition by mix_name order by finish, source, pass, doc_id) as position, source, doc_id, pass, tokens from taken where run <= budget_tokens
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_win_matrix": _GAMES + """select winner, loser, sum(w) wins from (
            select item_a winner, item_b loser, cast(score as double) w from games_once where item_a <> item_b
            union all select item_b, item_a, 1 - cast(score as double) from games_once where item_a <> item_b) group by all""",
        "p1_strengths": _STRENGTHS,
        "p1_found": f"select place, stage from ({_STRENGTHS})",
        "p2_found": f"""
            with rows as (select distinct sample_name, draw_no, lower(trim(item_kind)) kind, {_KEY} k from sample_draws),
            live as (select 'game' kind, cast(game_id as varchar) k from games union select 'puzzle', trim(puzzle_id) from puzzles)
            select r.sample_name, r.draw_no + 1 draw_no, r.k item_key from rows r
            where r.k is not null and exists (select 1 from rows m where m.sample_name = r.sample_name and m.draw_no = r.draw_no + 1)
              and not exists (select 1 from rows m where m.sample_name = r.sample_name and m.draw_no = r.draw_no + 1 and m.kind = r.kind and m.k = r.k)
              and exists (select 1 from live l where l.kind = r.kind and l.k = r.k)""",
        "p2_games_sample": _sample("games", "game_id", 1, 10, "games"),
        "p2_puzzles_sample": _sample("puzzles", "puzzle_id", 1, 4, "puzzles"),
        "p3_found": _TORN,
        "p3_roots_by_batches": _REACH + "select a game_id, least(a, min(b)) root from reach group by a",
        "p3_splits": _SPLITS,
        "p3_split_report": f"select split, count(distinct root) games, count(distinct game_id) ids, count(*) records, count(*) filter (root is null) no_game from ({_SPLITS}) group by split",
        "p4_found": _SURVIVORS,
        "p4_filled_fields": _FILLED,
        "p5_target_report": _TARGETS,
        "p5_found": f"select sample_name, category from ({_TARGETS}) where shortfall > 0",
        "p6_pieces_by_characters": "select doc_id, cast(greatest(1, ceil(coalesce(length(text), 0) / 2048)) as bigint) pieces, cast(coalesce(length(text), 0) as bigint) characters, cast(least(coalesce(length(text), 0), 2048) as bigint) largest, cast(ceil(coalesce(length(text), 0) / 2048) as bigint) bins from documents",
        "p6_bins_by_characters": "select cast(sum(length(text)) as bigint) characters, cast(0 as bigint) too_full, true dense from documents",
        "p7_mix_by_characters": _MIX,
    }
