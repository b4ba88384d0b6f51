"""SQL generators for the checks, written independently of the Spark operators."""

from __future__ import annotations

from .data import BASE_SPECS, SLICES
from .registry import cte

W = 8
CLASSES = range(10)
TWO64 = "18446744073709551616::UHUGEINT"
# generator constants (fixed values)
STEP, MUL1, MUL2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def draws(source: str, seed: str, index: str, columns: str) -> str:
    """Random word `w` for the rows of `source`."""
    return f"""
SELECT {columns}, CAST(xor(z, z >> 31) >> 32 AS BIGINT) AS w FROM (
 SELECT {columns}, CAST((xor(z, z >> 27)::UHUGEINT * {MUL2}::UHUGEINT) % {TWO64} AS UBIGINT) AS z FROM (
  SELECT {columns}, CAST((xor(z, z >> 30)::UHUGEINT * {MUL1}::UHUGEINT) % {TWO64} AS UBIGINT) AS z FROM (
   SELECT {columns}, CAST((CAST({seed} AS UHUGEINT) + (CAST({index} AS UHUGEINT) + 1) * {STEP}::UHUGEINT) % {TWO64} AS UBIGINT) AS z
   FROM {source})))"""


def levels(enc: str, m: int, v: str = "v") -> str:
    """Level of a byte expression."""
    unit = f"({v} / 255e0)"

    def rounded(x: str) -> str:
        return f"CAST(floor({x} * {m} + 0.5e0) AS BIGINT)"

    if enc == "lin7":
        return f"({v} >> 5)"
    if enc == "lin":
        return f"(({v} * {m}) >> 8)"
    if enc == "down":
        low = m * 3 // 7
        return f"CASE WHEN {v} < 64 THEN {v} * {low} // 64 ELSE {low} + ({v} - 64) * {m - low} // 192 END"
    if enc == "up":
        low = m * 4 // 7
        return f"CASE WHEN {v} > 192 THEN {low} + ({v} - 192) * {m - low} // 63 ELSE {v} * {low} // 192 END"
    if enc == "mid":
        low = m * 3 // 8
        mid = m - low
        return (f"CASE WHEN {v} < 80 THEN {v} * {low} // 80 WHEN {v} > 175 THEN {low} + ({v} - 175) * {mid} // 80 "
                f"ELSE {low} + ({v} - 80) * {mid} // 95 END")
    if enc == "tri":
        return f"(CASE WHEN {v} < 128 THEN {v} ELSE 255 - {v} END) * {m} * 2 // 255"
    return rounded({
        "log": f"(log2({v} + 1) / 8e0)",
        "exp": f"pow({unit}, {0.35 if m == 16 else 0.3}e0)",
        "sig": f"(1e0 / (1e0 + exp(-12e0 * ({unit} - 0.5e0))))",
        "sqrt": f"sqrt({unit})",
        "cbrt": f"pow({unit}, 1e0 / 3e0)",
        "gamma": f"pow({unit}, 0.45e0)",
        "inv-exp": f"(1e0 - exp(-4e0 * {v} / 255e0))",
    }[enc])


def code(enc: str, m: int = 8, v: str = "v") -> str:
    if enc == "raw":
        return f"CAST({v} AS BIGINT)"
    level = levels(enc, m, v)
    return f"CASE WHEN ({level}) <= 0 THEN 0::BIGINT WHEN ({level}) >= 32 THEN 4294967295 ELSE (1::BIGINT << CAST({level} AS INTEGER)) - 1 END"


def source_of(xform: str, w: int = W) -> str:
    """Source position for destination (y, x), NULL where filled."""
    last = w - 1
    plain = {
        "id": ("y", "x"), "rot0": ("y", "x"), "hflip": ("y", f"{last} - x"), "vflip": (f"{last} - y", "x"),
        "dflip1": ("x", "y"), "dflip2": (f"{last} - x", f"{last} - y"), "rot90": (f"{last} - x", "y"),
        "rot270": ("x", f"{last} - y"),
    }
    if xform in plain:
        y, x = plain[xform]
        return f"({y}) * {w} + ({x})"
    if xform.startswith("sft-"):
        n, way = int(xform[-1]), xform[4]
        y, x = {"u": (f"y + {n}", "x"), "d": (f"y - {n}", "x"), "l": ("y", f"x + {n}"), "r": ("y", f"x - {n}")}[way]
        return f"CASE WHEN {y} BETWEEN 0 AND {last} AND {x} BETWEEN 0 AND {last} THEN ({y}) * {w} + ({x}) END"
    if xform.startswith("colswap"):
        k = int(xform.split("-")[1])
        g = 4 - k
        return (f"y * {w} + CASE WHEN x % 4 = {k} AND x + {g} <= {last} THEN x + {g} "
                f"WHEN x % 4 = 0 AND x > 0 THEN x - {g} ELSE x END")
    angle = int(xform[3:]) + (0.5 if int(xform[3:]) % 45 else 0)
    rad = f"(CAST({angle} AS FLOAT) * CAST(pi() AS FLOAT) / CAST(180 AS FLOAT))"
    c, s = f"CAST(cos({rad}::DOUBLE) AS FLOAT)", f"CAST(sin({rad}::DOUBLE) AS FLOAT)"
    mid = f"CAST({last / 2} AS FLOAT)"
    dx, dy, half = f"(x::FLOAT - {mid})", f"(y::FLOAT - {mid})", "CAST(0.5 AS FLOAT)"
    sx = f"CAST(trunc({c} * {dx} + {s} * {dy} + {mid} + {half}) AS INTEGER)"
    sy = f"CAST(trunc(-{s} * {dx} + {c} * {dy} + {mid} + {half}) AS INTEGER)"
    return f"CASE WHEN {sx} BETWEEN 0 AND {last} AND {sy} BETWEEN 0 AND {last} THEN {sy} * {w} + {sx} END"


def grid_sql(xform: str, src: str = "c_px", w: int = W) -> str:
    """(sample_id, pos, v) after one reshaping step of a gray grid."""
    if xform.startswith("avg"):
        n = int(xform[-1])
        return f"""SELECT sample_id, y * {w} + x AS pos, CAST(sum(v) // {n} AS INTEGER) AS v FROM (
 SELECT s.sample_id, s.v, s.pos // {w} AS y, (s.pos % {w} - k.k + {w}) % {w} AS x
 FROM {src} s, (SELECT unnest(range({n})) AS k) k) GROUP BY ALL"""
    if xform.startswith("shuffle"):
        seed = int(xform[7:] or 42)
        order = draws(f"(SELECT unnest(range({w * w})) AS p)", str(seed), "p", "p")
        return f"""SELECT s.sample_id, o.pos, s.v FROM {src} s JOIN (
 SELECT p, row_number() OVER (ORDER BY w, p) - 1 AS pos FROM ({order})) o ON o.p = s.pos"""
    if xform == "spiral":
        return f"""SELECT sample_id, pos, CASE WHEN bool_and(inside) THEN CAST(least(255, greatest(0, floor(round(sum(v * wt), 9) + 0.5e0))) AS INTEGER) ELSE 128 END AS v
FROM (SELECT s.sample_id, t.pos, t.inside, s.v, t.wt FROM c_spiral_taps t JOIN {src} s ON s.pos = t.src) GROUP BY sample_id, pos"""
    return f"""SELECT k.sample_id, g.pos, coalesce(s.v, 0) AS v
FROM (SELECT DISTINCT sample_id FROM {src}) k CROSS JOIN (SELECT pos, {source_of(xform, w)} AS src FROM c_cells) g
LEFT JOIN {src} s ON s.sample_id = k.sample_id AND s.pos = g.src"""


def stencil_sql(kind: str, src: str = "c_px", w: int = W) -> str:
    """(sample_id, pos, v) of one neighbourhood channel."""
    m = 2 if kind == "dog" else 1
    lo, hi = m, w - 1 - m
    near = f"""SELECT p.sample_id, p.pos, n.v, n.pos // {w} - p.cy AS dy, n.pos % {w} - p.cx AS dx FROM (
  SELECT sample_id, pos, least(greatest(pos // {w}, {lo}), {hi}) AS cy, least(greatest(pos % {w}, {lo}), {hi}) AS cx FROM {src}) p
 JOIN {src} n ON n.sample_id = p.sample_id AND abs(n.pos // {w} - p.cy) <= {m} AND abs(n.pos % {w} - p.cx) <= {m}"""
    gx = "sum(v * dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END)"
    gy = "sum(v * dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END)"
    if kind in ("edge", "C"):
        div = 6 if kind == "edge" else 4
        return f"""SELECT sample_id, pos, CAST(least(255, floor(sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) / {div}e0 + 0.5e0)) AS INTEGER) AS v
FROM (SELECT sample_id, pos, {gx} AS gx, {gy} AS gy FROM ({near}) GROUP BY ALL)"""
    if kind == "dir":
        return f"""SELECT sample_id, pos, CAST(32 * CASE WHEN gx = 0 AND gy = 0 THEN 0
 WHEN abs(gx) > 2 * abs(gy) THEN CASE WHEN gx >= 0 THEN 0 ELSE 4 END
 WHEN abs(gy) > 2 * abs(gx) THEN CASE WHEN gy >= 0 THEN 2 ELSE 6 END
 WHEN gx >= 0 AND gy >= 0 THEN 1 WHEN gx < 0 AND gy >= 0 THEN 3 WHEN gx < 0 THEN 5 ELSE 7 END AS INTEGER) AS v
FROM (SELECT sample_id, pos, {gx} AS gx, {gy} AS gy FROM ({near}) GROUP BY ALL)"""
    if kind == "range":
        return f"SELECT sample_id, pos, CAST(max(v) - min(v) AS INTEGER) AS v FROM ({near}) GROUP BY ALL"
    if kind == "var":
        return f"""SELECT sample_id, pos, CAST(sum(abs(v - mean)) // 9 AS INTEGER) AS v FROM (
 SELECT *, sum(v) OVER (PARTITION BY sample_id, pos) // 9 AS mean FROM ({near})) GROUP BY ALL"""
    if kind == "dog":
        return f"""SELECT sample_id, pos, CAST(least(255, greatest(0,
 sum(v) FILTER (abs(dx) <= 1 AND abs(dy) <= 1) // 9 - sum(v) // 25 + 128)) AS INTEGER) AS v FROM ({near}) GROUP BY ALL"""
    if kind == "lbp":
        return f"""SELECT sample_id, pos, CAST(sum(CASE WHEN v >= mid THEN weight ELSE 0 END) AS INTEGER) AS v FROM (
 SELECT *, max(v) FILTER (dx = 0 AND dy = 0) OVER (PARTITION BY sample_id, pos) AS mid,
  CASE (dy + 1) * 3 + dx + 1 WHEN 0 THEN 128 WHEN 1 THEN 64 WHEN 2 THEN 32 WHEN 5 THEN 16 WHEN 8 THEN 8 WHEN 7 THEN 4 WHEN 6 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS weight
 FROM ({near})) GROUP BY ALL"""
    if kind == "bin":
        return f"""SELECT p.sample_id, p.pos, CASE WHEN p.v > coalesce(t.t, 128) THEN 255 ELSE 0 END AS v FROM {src} p LEFT JOIN (
 SELECT sample_id, v AS t FROM (SELECT sample_id, v, row_number() OVER (PARTITION BY sample_id ORDER BY spread DESC, v) AS rn FROM (
  SELECT sample_id, v, wb::DOUBLE * (wt - wb) * (sb / wb - (st - sb) / (wt - wb)) * (sb / wb - (st - sb) / (wt - wb)) AS spread FROM (
   SELECT sample_id, v, CAST(sum(n) OVER o AS BIGINT) AS wb, CAST(sum(v * n) OVER o AS DOUBLE) AS sb,
    CAST(sum(n) OVER a AS BIGINT) AS wt, CAST(sum(v * n) OVER a AS DOUBLE) AS st
   FROM (SELECT sample_id, v, count(*) AS n FROM {src} GROUP BY ALL)
   WINDOW o AS (PARTITION BY sample_id ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY sample_id))
  WHERE wt > wb) WHERE spread > 0) WHERE rn = 1) t ON t.sample_id = p.sample_id"""
    raise ValueError(kind)


def chain_sql(xform: str, channel: str) -> str:
    sql = "c_px"
    for step in xform.split("@"):
        if step not in ("id", "rot0"):
            sql = f"({grid_sql(step, sql)})"
    if channel != "mnist":
        sql = f"({stencil_sql(channel, sql)})"
    return sql


def words_sql(xform: str, channel: str, enc: str, width: int = 8) -> str:
    """(sample_id, split, label, h, w) of one spec."""
    per = 32 // width
    return f"""SELECT s.sample_id, s.split, s.label, CAST(pos // {per} AS INTEGER) AS h,
 CAST(sum(({code(enc, width, 'g.v')}) << CAST({width} * (pos % {per}) AS INTEGER)) AS BIGINT) AS w
FROM {chain_sql(xform, channel)} g JOIN c_samples s ON s.sample_id = g.sample_id GROUP BY ALL"""


def register_learning(p: str, words: str, n_bits: int = 32) -> None:
    """Sub-queries of counting and scoring over c_<p>_words."""
    cte(f"c_{p}_words", words)
    cte(f"c_{p}_bits", f"""SELECT member_id, sample_id, split, label, h, CAST(v AS INTEGER) AS v
FROM c_{p}_words, (SELECT unnest(range({n_bits})) AS v) b WHERE (w >> CAST(v AS INTEGER)) & 1 = 1""")
    cte(f"c_{p}_ids", f"SELECT DISTINCT member_id FROM c_{p}_words")
    cte(f"c_{p}_nk", f"""SELECT i.member_id, k.class_id, count(s.sample_id) AS n_k FROM c_{p}_ids i CROSS JOIN c_classes k
LEFT JOIN c_samples s ON s.label = k.class_id AND s.split = 'train' GROUP BY ALL""")
    cte(f"c_{p}_hits", f"""SELECT g.member_id, k.class_id, g.h, CAST(b.v AS INTEGER) AS v, count(x.sample_id) AS t
FROM (SELECT DISTINCT member_id, h FROM c_{p}_words) g CROSS JOIN c_classes k CROSS JOIN (SELECT unnest(range({n_bits})) AS v) b
LEFT JOIN (SELECT * FROM c_{p}_bits WHERE split = 'train') x
 ON x.member_id = g.member_id AND x.label = k.class_id AND x.h = g.h AND x.v = b.v GROUP BY ALL""")
    cte(f"c_{p}_w", f"""SELECT t.member_id, t.class_id, t.h, t.v, CASE WHEN n_k > 0 THEN
 CAST(round(ln(((t + 1)::DOUBLE / (n_k + 2)) / (1 - (t + 1)::DOUBLE / (n_k + 2))) * 131072e0) AS BIGINT) ELSE t END AS w
FROM c_{p}_hits t JOIN c_{p}_nk n ON n.member_id = t.member_id AND n.class_id = t.class_id""")
    cte(f"c_{p}_off", f"""SELECT t.member_id, t.class_id,
 CAST(round(sum(CASE WHEN n_k > 0 THEN ln((n_k - t + 1)::DOUBLE / (n_k + 2)) ELSE 0e0 END) * 131072e0) AS BIGINT) AS off
FROM c_{p}_hits t JOIN c_{p}_nk n ON n.member_id = t.member_id AND n.class_id = t.class_id GROUP BY ALL""")
    cte(f"c_{p}_scores", f"""SELECT o.member_id, s.sample_id, s.split, s.label, o.class_id, CAST(o.off + coalesce(x.total, 0) AS BIGINT) AS score
FROM c_{p}_off o CROSS JOIN c_samples s LEFT JOIN (
 SELECT b.member_id, b.sample_id, w.class_id, sum(w.w) AS total FROM c_{p}_bits b
 JOIN c_{p}_w w ON w.member_id = b.member_id AND w.h = b.h AND w.v = b.v GROUP BY ALL) x
 ON x.member_id = o.member_id AND x.sample_id = s.sample_id AND x.class_id = o.class_id""")
    cte(f"c_{p}_pred", f"""SELECT member_id, sample_id, split, label, CAST(arg_max(class_id, score * 16 - class_id) AS INTEGER) AS pred,
 CAST(max(score) - list_extract(list_sort(list(score), 'DESC'), 2) AS BIGINT) AS margin
FROM c_{p}_scores GROUP BY member_id, sample_id, split, label""")


cte("c_samples", "SELECT vec_id AS sample_id, CASE WHEN vec_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split, label FROM embeddings")
cte("c_px", """SELECT vec_id AS sample_id, i - 1 AS pos,
 CAST(least(greatest(floor((CAST(embedding[i] AS DOUBLE) - (-0.6e0)) / 1.2e0 * 255), 0), 255) AS INTEGER) AS v
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
cte("c_cells", f"SELECT CAST(p AS INTEGER) AS pos, CAST(p // {W} AS INTEGER) AS y, CAST(p % {W} AS INTEGER) AS x FROM (SELECT unnest(range({W * W})) AS p)")
_f = "CAST({} AS FLOAT)".format
_mid, _reach = _f(W / 2 - 0.5), f"({_f(W / 2)} * {_f(0.7)})"
cte("c_spiral", f"""SELECT *, CASE WHEN inside THEN iy * {W} + ix ELSE 0 END AS i, CAST(sx - ix::FLOAT AS DOUBLE) AS fx, CAST(sy - iy::FLOAT AS DOUBLE) AS fy FROM (
 SELECT *, ix BETWEEN 0 AND {W - 2} AND iy BETWEEN 0 AND {W - 2} AS inside FROM (
  SELECT *, CAST(trunc(sx) AS INTEGER) AS ix, CAST(trunc(sy) AS INTEGER) AS iy FROM (
   SELECT pos, {_mid} + r * CAST(cos(t::DOUBLE) AS FLOAT) AS sx, {_mid} + r * CAST(sin(t::DOUBLE) AS FLOAT) AS sy FROM (
    SELECT pos, r, CAST(atan2(dy::DOUBLE, dx::DOUBLE) AS FLOAT) + {_f(8)} * CAST(exp((-r / {_reach})::DOUBLE) AS FLOAT) AS t FROM (
     SELECT *, CAST(sqrt((dx * dx + dy * dy)::DOUBLE) AS FLOAT) AS r FROM (
      SELECT pos, x::FLOAT - {_mid} AS dx, y::FLOAT - {_mid} AS dy FROM c_cells))))))""")
cte("c_spiral_taps", " UNION ALL ".join(
    f"SELECT pos, inside, i + {step} AS src, {wt} AS wt FROM c_spiral" for step, wt in
    [(0, "(1 - fx) * (1 - fy)"), (1, "fx * (1 - fy)"), (W, "(1 - fx) * fy"), (W + 1, "fx * fy")]))
cte("c_classes", "SELECT CAST(unnest(range(10)) AS INTEGER) AS class_id")
cte("c_padded", """SELECT sample_id, pos, v FROM c_px
UNION ALL SELECT sample_id, unnest(range(n, 75)) AS pos, 0 AS v FROM (SELECT sample_id, count(*) AS n FROM c_px GROUP BY sample_id)""")
cte("c_rgb", """SELECT a.sample_id, a.pos, a.v AS r, b.v AS g, c.v AS b FROM c_padded a
JOIN c_padded b ON b.sample_id = a.sample_id AND b.pos = a.pos + 25 JOIN c_padded c ON c.sample_id = a.sample_id AND c.pos = a.pos + 50
WHERE a.pos < 25""")

register_learning("plain", f"SELECT CAST(0 AS BIGINT) AS member_id, * FROM ({words_sql('id', 'mnist', 'lin')})")
register_learning("trio", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS member_id, * FROM ({words_sql(*s)})"
    for i, s in enumerate([("id", "mnist", "lin"), ("rot90", "mnist", "exp"), ("avg2", "mnist", "sig")])))
register_learning("corpus", " UNION ALL ".join(
    f"SELECT CAST({i * SLICES} + h // 4 AS BIGINT) AS member_id, sample_id, split, label, CAST(h % 4 AS INTEGER) AS h, w FROM ({words_sql(*s)})"
    for i, s in enumerate(BASE_SPECS)))
cte("c_members", " UNION ALL ".join(
    f"SELECT CAST({i * SLICES + s} AS BIGINT) AS member_id, '{x}:{c}:{e}8' AS spec" for i, (x, c, e) in enumerate(BASE_SPECS) for s in range(SLICES)))
# eval rows of the corpus: the score table of the ensemble queries
cte("c_fact", "SELECT member_id, sample_id, label, class_id, score FROM c_corpus_scores WHERE split = 'eval'")
cte("c_pred", "SELECT member_id, sample_id, label, pred, margin FROM c_corpus_pred WHERE split = 'eval'")

XF = "['id','hflip','rot90','rot22@avg4','rot0@id','rot45@spiral','sft-u1','colswap-1-4','avg2','warp']"
CH = "['mnist','edge','lbp','R','RG','H','range','alpha']"
EN = "['lin','exp','sig','sqrt','gamma','inv-exp','tri','foo']"
cte("c_arch", f"""SELECT *, xform || ':' || channel || ':' || encoding || width AS spec,
 CASE WHEN n_members = 3 THEN xform || ':mnist:' || encoding || width ELSE xform || ':' || channel || ':' || encoding || width END AS file_spec FROM (
SELECT p_partkey AS member_id, {XF}[p_partkey % 10 + 1] AS xform, {CH}[brand % 8 + 1] AS channel, {EN}[p_size % 8 + 1] AS encoding,
 CASE WHEN p_size = 50 THEN 12 ELSE [8, 16, 32][brand % 3 + 1] END AS width, p_size % 4 AS slice, CAST(p_size + brand AS BIGINT) AS seed,
 cents % 9973 AS file_time, 'archive-' || lpad(p_partkey::VARCHAR, 8, '0') || '.scores' AS source_file,
 (cents * 31 + brand * 977) % 6000 / 100e0 + 40e0 AS eval,
 [1, 1, 1, 3, -1][CASE WHEN p_size > 45 THEN 5 WHEN p_size > 40 THEN 4 ELSE p_size % 3 + 1 END] AS majority,
 CASE WHEN p_type = 'PROMO' THEN 'bv' ELSE 'proj' END AS kind, CASE WHEN p_size = 1 THEN 0 ELSE p_size * 1000 END AS n_samples,
 CASE WHEN p_size = 2 THEN 2000 ELSE 10 END AS n_classes, brand AS n_members, p_size % 7 + 9 AS version,
 196 AS hidden, CASE WHEN p_size = 3 THEN 5 ELSE 10 END AS epochs, 1 AS vn, 1 AS hn, 32 AS bits, 17 AS precision,
 'int32' AS counter_type, CASE WHEN brand = 7 THEN 'double' ELSE 'int64' END AS score_type
FROM (SELECT *, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS brand, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part))""")
