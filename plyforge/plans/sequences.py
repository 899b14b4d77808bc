"""Movetext and names, hashes, vocabularies, packing, masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.chess.frames import spread
from plyforge.functions import ids, positions, text, vocab
from plyforge.operators.ordering import salted_hash
from plyforge.plans.catalogue import register
from plyforge.plans.sampling import table

_PGN = "regexp_replace(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '[\\s-]+', '_', 'g') = 'pgn_dump'"
_DONE = "regexp_replace(regexp_replace(regexp_replace(x, '\\$[0-9]+', ' ', 'g'), '(?:1-0|0-1|1/2-1/2|\\*)\\s*$', ' '), '\\b[0-9]+\\.(?:\\.\\.)?', ' ', 'g')"


@register(f"""
    with recursive peeled(doc_id, x) as (
      select doc_id, regexp_replace(text, '\\{{[^}}]*\\}}', ' ', 'g') from documents where {_PGN}
      union all select doc_id, regexp_replace(x, '\\([^()]*\\)', ' ', 'g') from peeled where regexp_matches(x, '\\([^()]*\\)')),
    c as (select doc_id, trim(regexp_replace({_DONE}, '\\s+', ' ', 'g')) c from peeled where x is null or not regexp_matches(x, '\\([^()]*\\)'))
    select doc_id, md5(c) clean, cast(len(list_filter(list_transform(string_split(c, ' '), lambda t: regexp_replace(t, '[!?]+$', '')), lambda t: t <> '')) as bigint) tokens from c
""")
def clean_text(spark, d):
    """Clean movetext of the PGN dumps, however their source is spelled and however deep their variations."""
    docs = pgn_dumps(spark, d).withColumn("c", text.clean_movetext(F.col("text")))
    return docs.select("doc_id", F.md5("c").alias("clean"), F.size(text.san_tokens(F.col("c"))).cast("bigint").alias("tokens"))


def pgn_dumps(spark, d):
    """The PGN dumps among the documents, however the source is spelled."""
    name = F.regexp_replace(F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")), r"[\s-]+", "_")
    return table(spark, d, "documents").filter(name == "pgn_dump")


@register("select doc_id, regexp_replace(regexp_replace(split_part(trim(text), ' ', 1), '^[0-9]+\\.+', ''), '[!?]+$', '') answer from documents")
def answer_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", text.answer_move(F.col("text")).alias("answer"))


@register("select c_custkey, cast(md5(c_name) as varchar) m, sha256(c_name) s, sha256('{\"seed\":42,\"name\":\"' || c_name || '\"}') config from customer")
def hash_ids(spark, d):
    config = F.to_json(F.struct(F.lit(42).alias("seed"), F.col("c_name").alias("name")))
    return table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"), F.sha2(config, 256).alias("config"))


@register("""
    with h as (select game_id, batch_no, sha256(site) h from games where site is not null),
    b as (select *, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) x from h)
    select game_id, batch_no, cast(case when cast(('0x' || substr(x, 1, 8)) as bigint) >= 2147483648 then cast(('0x' || substr(x, 1, 8)) as bigint) - 4294967296 else cast(('0x' || substr(x, 1, 8)) as bigint) end * 4294967296::hugeint + cast(('0x' || substr(x, 9, 8)) as bigint) as bigint) link_id from b
""")
def link_ids(spark, d):
    return table(spark, d, "games").filter("site is not null").select("game_id", "batch_no", ids.text_id(F.col("site")).alias("link_id"))


@register("""
    with s as (select f.r f, r.r r from range(8) f(r), range(8) r(r)),
    m as (select 'abcdefgh'[a.f + 1] || (a.r + 1) || 'abcdefgh'[b.f + 1] || (b.r + 1) as token, row_number() over (order by a.f, a.r, b.f, b.r) + 61 id from s a, s b
      where (a.f, a.r) <> (b.f, b.r) and (a.f = b.f or a.r = b.r or abs(a.f - b.f) = abs(a.r - b.r) or (abs(a.f - b.f) in (1, 2) and abs(a.r - b.r) in (1, 2) and abs(a.f - b.f) <> abs(a.r - b.r))))
    select token, cast(id as bigint) id from m
""")
def vocab_crossjoin(spark, d):
    """The plain moves of the vocabulary with their ids."""
    return vocab.vocabulary_table(spark).filter("id >= 62 and id < 1854").select("token", F.col("id").cast("bigint").alias("id"))


_VOCABULARY = """
    s as (select f.r f, r.r r from range(8) f(r), range(8) r(r)),
    words as (
      select 'abcdefgh'[a.f + 1] || (a.r + 1) || 'abcdefgh'[b.f + 1] || (b.r + 1) as token, row_number() over (order by a.f, a.r, b.f, b.r) + 61 id from s a, s b
      where (a.f, a.r) <> (b.f, b.r) and (a.f = b.f or a.r = b.r or abs(a.f - b.f) = abs(a.r - b.r) or (abs(a.f - b.f) in (1, 2) and abs(a.r - b.r) in (1, 2) and abs(a.f - b.f) <> abs(a.r - b.r)))
      union all select 'abcdefgh'[a.r + 1] || w.a || 'abcdefgh'[c.r + 1] || w.b || 'qrbn'[p.r], row_number() over (order by w.a desc, a.r, c.r, p.r) + 1853
      from range(8) a(r), range(8) c(r), range(1, 5) p(r), (values ('7', '8'), ('2', '1')) w(a, b) where abs(a.r - c.r) < 2)
"""
_BIN = "(least(greatest({0}, 600), 3299) // 100 * 100 - 600) // 100"


@register(f"""
    with {_VOCABULARY},
    g as (select game_id, batch_no, row_number() over () k, list_filter(string_split(uci, ' '), lambda x: x <> '') m, white_elo w, black_elo b, result from games
          where uci is not null and white_elo is not null and black_elo is not null and result in ('1-0', '0-1', '1/2-1/2')),
    e as (select k, unnest(m) token, generate_subscripts(m, 1) i from g),
    i as (select k, list(coalesce(id, 4) order by i) ids from e left join words using (token) group by k)
    select game_id, batch_no, array_to_string(list_slice([1, {_BIN.format("w")} + 8, {_BIN.format("b")} + 35] || coalesce(ids, []) || [case result when '1-0' then 5 when '0-1' then 6 else 7 end, 2], 1, 200), ' ') ids from g left join i using (k)
""")
def encode_sequences(spark, d):
    """Token ids of encoded games, cut at the block of 200."""
    rows = vocab.encode_games(spread(table(spark, d, "games").select("game_id", "batch_no", "uci", "white_elo", "black_elo", "result"))).filter("ids is not null")
    return rows.select("game_id", "batch_no", _joined("ids").alias("ids"))


def _joined(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


@register(f"""
    with t as (select doc_id, regexp_replace(text, '^(?:\\[[^\\]]*\\]\\s*)+', '') t from documents where {_PGN})
    select doc_id, case when regexp_matches(t, '^[ #+\\-.0-9=BKNOQRabcdefghx/]*$') then array_to_string([1] || list_transform(string_split(t, ''), lambda c: instr(' #+-.0123456789=BKNOQRabcdefghx/', c) + 2) || [2], ' ') end ids from t where t <> ''
    union all select doc_id, '1 2' from t where t = '' union all select doc_id, null from t where t is null
""")
def char_tokenize(spark, d):
    """Character ids of the PGN dumps without their headers; null where a character is foreign."""
    docs = pgn_dumps(spark, d).withColumn("t", F.regexp_replace("text", r"^(?:\[[^\]]*\]\s*)+", ""))
    return docs.select("doc_id", _joined(vocab.encode_characters(F.col("t"))).alias("ids"))


_EXPAND = "replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(fen, ' ', 1), '8', '........', 'g'), '7', '.......', 'g'), '6', '......', 'g'), '5', '.....', 'g'), '4', '....', 'g'), '3', '...', 'g'), '2', '..', 'g'), '1', '.', 'g'), '/', '')"


@register(f"""
    select label_id, array_to_string([2] || list_transform(range(64), lambda i: case when substr(b, cast((7 - i % 8) * 8 + i // 8 + 1 as bigint), 1) = '.' then 3 else instr('PNBRQKpnbrqk', substr(b, cast((7 - i % 8) * 8 + i // 8 + 1 as bigint), 1)) + 3 end)
      || [case when split_part(fen, ' ', 2) = 'w' then 16 else 17 end, 18 + cast(contains(c, 'K') as integer) + 2 * cast(contains(c, 'Q') as integer) + 4 * cast(contains(c, 'k') as integer) + 8 * cast(contains(c, 'q') as integer),
          34 + case when e = '-' then 0 else ascii(e) - 96 end, 43], ' ') tokens
    from (select label_id, fen, {_EXPAND} b, split_part(fen, ' ', 3) c, split_part(fen, ' ', 4) e from label_rows where fen is not null)
""")
def fen_squares(spark, d):
    rows = spread(table(spark, d, "label_rows").select("label_id", "fen").filter("fen is not null"))
    return rows.select("label_id", F.array_join(F.transform(positions.position_tokens(F.col("fen")), lambda x: x.cast("string")), " ").alias("tokens"))


@register(f"""
    select label_id, length(replace(b, '.', '')) pieces, {'+'.join(f"{v} * ((length(b) - length(replace(b, '{p.upper()}', ''))) - (length(b) - length(replace(b, '{p}', ''))))" for p, v in positions.VALUES.items())} material,
      case when ply <= 10 then 'opening' when length(replace(b, '.', '')) >= 14 then 'middlegame' else 'endgame' end phase, array_to_string(string_split(fen, ' ')[1:4], ' ') fen4
    from (select label_id, ply, fen, {_EXPAND} b from label_rows where fen is not null)
""")
def phase_and_fields(spark, d):
    board = F.split_part("fen", F.lit(" "), F.lit(1))
    pieces = positions.n_pieces(board)
    return table(spark, d, "label_rows").filter("fen is not null").select("label_id", pieces.alias("pieces"), positions.material(board).alias("material"), positions.phase(F.col("ply"), pieces).alias("phase"), positions.four_fields(F.col("fen")).alias("fen4"))


def pack_offsets_of(df: DataFrame, order_hash: str, n: str, ties: list[str]) -> DataFrame:
    """Adds ``start``: tokens before each row in hash order, without sorting all rows in one task."""
    from plyforge.operators.ordering import running_sum

    keyed = df.withColumn("one", F.lit(1)).withColumn("bucket", F.substring(order_hash, 1, 3))
    return running_sum(keyed, ["one"], "bucket", [order_hash, *ties], n, name="upto").withColumn("start", F.col("upto") - F.col(n)).drop("one", "bucket", "upto", "upto_total")


@register("""
    select game_id, batch_no, n, cast(sum(n) over (order by md5('pack:' || game_id), game_id, batch_no, n rows unbounded preceding) - n as bigint) as start from (select game_id, batch_no, cast(len(string_split(uci, ' ')) + 5 as bigint) n from games where uci is not null)
""")
def pack_offsets(spark, d):
    rows = table(spark, d, "games").filter("uci is not null").select("game_id", "batch_no", (F.size(F.split("uci", " ")) + 5).cast("bigint").alias("n")).withColumn("h", salted_hash("pack", F.col("game_id")))
    return pack_offsets_of(rows, "h", "n", ["game_id", "batch_no", "n"]).select("game_id", "batch_no", "n", "start")


@register("""
    with t as (select game_id, batch_no, string_split(uci, ' ') m from games where uci is not null), s as (select *, cast(sum(len(m)) over (order by md5('pack:' || game_id), game_id, batch_no, m rows unbounded preceding) - len(m) as bigint) as start from t),
    e as (select start + i - 1 pos, m[i] mv from (select start, m, unnest(range(1, len(m) + 1)) i from s))
    select pos // 256 as block, string_agg(mv, ' ' order by pos) x, count(*) n from e group by 1
""")
def block_windows(spark, d):
    """Consecutive blocks of 256 tokens of the packed stream; the next-token shift is the block moved by one."""
    rows = table(spark, d, "games").filter("uci is not null").select("game_id", "batch_no", F.split("uci", " ").alias("m")).withColumn("n", F.size("m").cast("bigint")).withColumn("h", salted_hash("pack", F.col("game_id")))
    stream = pack_offsets_of(rows, "h", "n", ["game_id", "batch_no", "m"]).select("start", F.posexplode("m").alias("i", "mv")).select((F.col("start") + F.col("i")).alias("pos"), "mv")
    blocks = stream.groupBy(F.expr("pos div 256").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "mv"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return blocks.select("block", F.array_join(F.transform("x", lambda t: t["mv"]), " ").alias("x"), "n")


@register("""
    with g as (select game_id, batch_no, string_split(uci, ' ') m from games where uci is not null),
    w as (select *, unnest(range(0, greatest(len(m) - 2, 0) // 200 + 1)) "window" from g)
    select game_id, batch_no, "window", array_to_string(list_slice(m, "window" * 200 + 2, "window" * 200 + 201) || list_transform(range(200 - len(list_slice(m, "window" * 200 + 2, "window" * 200 + 201))), lambda x: '<pad>'), ' ') y from w
""")
def shifted_window(spark, d):
    """Targets of the consecutive windows of 200 tokens of each whole game: its tokens moved by one, filled up with pad."""
    games = table(spark, d, "games").filter("uci is not null").withColumn("m", F.split("uci", " "))
    rows = games.select("game_id", "batch_no", "m", F.explode(F.sequence(F.lit(0), F.expr("greatest(size(m) - 2, 0) div 200").cast("int"))).alias("window"))
    y = F.slice("m", F.col("window") * 200 + 2, 200)
    return rows.select("game_id", "batch_no", "window", F.array_join(F.concat(y, F.array_repeat(F.lit("<pad>"), F.lit(200) - F.size(y))), " ").alias("y"))


@register(f"""
    with {_VOCABULARY},
    g as (select game_id, batch_no, row_number() over () k, string_split(uci, ' ') m from games where uci is not null),
    e as (select k, unnest(m) token, generate_subscripts(m, 1) i from g),
    i as (select k, list(coalesce(id, 4) order by i) ids from e left join words using (token) group by k)
    select game_id, batch_no, array_to_string(ids || list_transform(range(max(len(ids)) over (partition by batch_no) - len(ids)), lambda x: 0), ' ') padded, cast(len(ids) as bigint) "real" from g join i using (k)
""")
def padded_batches(spark, d):
    """Move ids of whole games, padded to the longest of their batch (batch_no)."""
    ids_ = F.transform(F.split("uci", " "), lambda m: F.coalesce(vocab.move_id(m), F.lit(4)))
    rows = spread(table(spark, d, "games").filter("uci is not null").select("game_id", "batch_no", "uci"))
    width = rows.groupBy(F.col("batch_no").alias("b")).agg(F.max(F.size(F.split("uci", " "))).alias("width"))
    # a row a batch
    rows = rows.withColumn("ids", ids_).join(F.broadcast(width), F.col("batch_no").eqNullSafe(F.col("b")))
    return rows.select("game_id", "batch_no", _joined(vocab.pad_ids(F.col("ids"), F.col("width"))).alias("padded"), F.size("ids").cast("bigint").alias("real"))


@register("""
    with t as (select label_id, unnest(range(64)) i, fen from label_rows where fen is not null), u as (select label_id, i, cast(('0x' || substr(md5('mask:' || label_id || ':' || i), 1, 8)) as bigint) % 10000 a, cast(('0x' || substr(md5('mask:' || label_id || ':' || i), 9, 8)) as bigint) % 100 b from t)
    select cast(count(*) as bigint) n, count(*) filter (a < 1500) masked, count(*) filter (a < 1500 and b < 80) hidden, count(*) filter (a < 1500 and b >= 80 and b < 90) swapped, count(*) filter (a < 1500 and b >= 90) kept from u
""")
def masking_80_10_10(spark, d):
    """15 % of tokens chosen by hash of row and place, then 80/10/10; no shuffle before the counts."""
    rows = table(spark, d, "label_rows").filter("fen is not null").select("label_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).withColumn("h", salted_hash("mask", F.col("label_id"), F.col("i")))
    part = lambda at, mod: F.conv(F.substring("h", at, 8), 16, 10).cast("bigint") % mod
    a, b = part(1, 10000) < 1500, part(9, 100)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("masked"), F.count_if(a & (b < 80)).alias("hidden"), F.count_if(a & (b >= 80) & (b < 90)).alias("swapped"), F.count_if(a & (b >= 90)).alias("kept"))


@register("select 'moves' as scheme, count(*) n, round(avg(k), 6) mean, quantile_cont(k, 0.5) p50, quantile_cont(k, 0.95) p95, round(avg(cast(k <= 200 as integer)), 6) fits from (select len(string_split(uci, ' ')) + 5 k from games where uci is not null) union all select 'letters', count(*), round(avg(k), 6), quantile_cont(k, 0.5), quantile_cont(k, 0.95), round(avg(cast(k <= 200 as integer)), 6) from (select length(replace(uci, ' ', '')) + 2 k from games where uci is not null)")
def tokens_per_doc_stats(spark, d):
    games = table(spark, d, "games").filter("uci is not null")
    sizes = F.array(F.struct(F.lit("moves").alias("scheme"), (F.size(F.split("uci", " ")) + 5).alias("k")), F.struct(F.lit("letters").alias("scheme"), (F.length(F.replace("uci", F.lit(" "), F.lit(""))) + 2).alias("k")))
    long = games.select(F.explode(sizes).alias("x")).select("x.*")
    return long.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("k"), 6).alias("mean"), F.percentile("k", F.lit(0.5)).alias("p50"), F.percentile("k", F.lit(0.95)).alias("p95"), F.round(F.avg((F.col("k") <= 200).cast("double")), 6).alias("fits"))


@register("select o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9_.\\- ]', '_', 'g') || '/' || regexp_replace(o_orderstatus, '[^A-Za-z0-9_.\\- ]', '_', 'g') as metric, case when o_orderstatus like '%F' then substr(o_orderstatus, 1, length(o_orderstatus) - 1) else o_orderstatus || 'F' end toggled from orders")
def safe_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.metric_name(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("metric"), text.toggle_suffix(F.col("o_orderstatus"), "F").alias("toggled"))


@register("select r_regionkey, unnest([0, 2, 5, 6, 7]) + r_regionkey as file_no from region")
def index_spec_expand(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.explode(text.index_spec(F.lit("0, 2,5-7,6"))).alias("i")).select("r_regionkey", (F.col("i") + F.col("r_regionkey")).alias("file_no"))


@register("""
    select game_id, batch_no, replace(uci, ' ', '') letters, '<w' || lpad(cast(least(greatest(white_elo, 600), 3299) // 100 * 100 as varchar), 4, '0') || '>' tok, cast(n_plies >= 6 as integer) + cast(n_plies >= 25 as integer) + cast(n_plies >= 50 as integer) clock,
      case when white_elo - black_elo >= 100 then '1-0' when white_elo - black_elo <= -100 then '0-1' else '1/2-1/2' end verdict, round(1 / (1 + power(10, (black_elo - white_elo) / 400)), 6) expected
    from games where uci is not null and white_elo is not null and black_elo is not null and n_plies is not null
""")
def bucket_scalars(spark, d):
    from plyforge.functions import scoring

    g = table(spark, d, "games").dropna(subset=["uci", "white_elo", "black_elo", "n_plies"])
    gap = F.col("white_elo").cast("int") - F.col("black_elo").cast("int")
    return g.select("game_id", "batch_no", F.replace("uci", F.lit(" "), F.lit("")).alias("letters"), vocab.elo_token(F.col("white_elo"), "w").alias("tok"), positions.clock_bucket(F.col("n_plies")).alias("clock"), scoring.verdict(gap, 100).alias("verdict"), F.round(scoring.expected_score(F.col("white_elo").cast("double"), F.col("black_elo").cast("double")), 6).alias("expected"))


@register("""
    with o as (select *, row_number() over (partition by y order by o_orderdate, o_orderkey) n from (select year(o_orderdate) y, o_orderdate, o_orderkey from orders)), c as (select y, count(*) n from o group by 1)
    select o.o_orderkey, cast(coalesce((select sum(n) from c where c.y < o.y), 0) + o.n - 1 as bigint) as place from o
""")
def ordered_concat_offsets(spark, d):
    """Absolute places of rows of sources put one after the other, by ranges of the common order."""
    from plyforge.operators.ordering import range_running_sum

    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"), F.lit(1).alias("one"))
    return range_running_sum(o, ["y", "o_orderdate", "o_orderkey"], "one", name="upto").select("o_orderkey", (F.col("upto") - 1).alias("place"))


@register("select distinct cast(year(o_orderdate) as bigint) y, o_orderstatus status, 'orders' src from orders union select distinct cast(year(l_shipdate) as bigint), l_linestatus, 'lineitem' from lineitem")
def union_members(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderstatus").alias("status"), F.lit("orders").alias("src"))
    l = table(spark, d, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("y"), F.col("l_linestatus").alias("status"), F.lit("lineitem").alias("src"))  # noqa: E741
    return o.unionByName(l).distinct()


@register("select game_id, batch_no, cast(n_plies as bigint) n, cast(coalesce(lag(n_plies) over (partition by white_name order by utc_date, game_id, batch_no), 0) as bigint) before from games")
def emission_key(spark, d):
    """The row before, by a stated order within a key."""
    from plyforge.operators.ordering import previous_row

    g = table(spark, d, "games").select("white_name", "utc_date", "game_id", "batch_no", F.col("n_plies").cast("bigint").alias("n"))
    return previous_row(g, ["white_name"], ["utc_date", "game_id", "batch_no"], "n", name="earlier").select("game_id", "batch_no", "n", F.coalesce("earlier", F.lit(0)).cast("bigint").alias("before"))


@register("""
    with p as (select puzzle_id, batch_no, list_filter(string_split(moves, ' '), lambda x: x <> '') m from puzzles), s as (select puzzle_id, batch_no, [m[i] for i in range(2, len(m) + 1) if i % 2 = 0] mine from p),
    g as (select *, [case when i = 2 and len(mine) > 1 and batch_no % 2 = 0 then 'a1a1' else mine[i] end for i in range(1, len(mine) + 1)] told from s)
    select puzzle_id, batch_no, cast(len(mine) as bigint) total, cast(case when mine = told then len(mine) else 1 end as bigint) correct, mine = told solved from g
""")
def line_solver(spark, d):
    """Solver's answers against the line: every second move is the solver's; counting stops at the first miss."""
    m = F.filter(F.split("moves", " "), lambda x: x != "")
    mine = F.filter(m, lambda x, i: i % 2 == 1)
    rows = table(spark, d, "puzzles").withColumn("mine", mine)
    told = F.transform("mine", lambda x, i: F.when((i == 1) & (F.col("batch_no") % 2 == 0), "a1a1").otherwise(x))
    same = F.zip_with("mine", told, lambda a, b: a == b)
    miss = F.array_position(same, False)
    correct = F.when(miss == 0, F.size("mine")).otherwise(miss - 1).cast("bigint")
    return rows.select("puzzle_id", "batch_no", F.size("mine").cast("bigint").alias("total"), correct.alias("correct"), (correct == F.size("mine")).alias("solved"))
