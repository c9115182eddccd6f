"""DuckDB counterparts. Each states the definition directly, not the distributed method."""

from __future__ import annotations

from pairlift.plans.downsample import draws
from workload.inputs import DISTANCE, DRAW_CHROMS, DRAWS, SAMPLES

LINE_KEY_SQL = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


def t_tail(t: str, df: int) -> str:
    """Two-sided t tail for whole df: the finite trigonometric series."""
    c = f"({df}.0 / ({df}.0 + ({t}) * ({t})))"
    s = f"(abs({t}) / sqrt({df}.0 + ({t}) * ({t})))"
    nest = "1.0"
    if df % 2 == 0:
        for j in range((df - 2) // 2, 0, -1):
            nest = f"(1.0 + c2 * {2 * j - 1}.0 / {2 * j}.0 * {nest})"
        inside = f"1.0 - sn * {nest}"
    else:
        for j in range((df - 3) // 2, 0, -1):
            nest = f"(1.0 + c2 * {2 * j}.0 / {2 * j + 1}.0 * {nest})"
        inside = f"1.0 - 2.0 / pi() * (asin(sn) + sn * sqrt(c2) * {nest})"
    return f"greatest(0.0, (SELECT {inside} FROM (SELECT {c} AS c2, {s} AS sn)))"


def bh(rows: str, p: str, n: str = "count(*) OVER ()", tie: str = "1") -> str:
    """``rows`` plus fdr, from ranks and a running minimum."""
    return f"""SELECT *, least(1.0, min(_n * {p} / _k) OVER (ORDER BY {p} DESC, _k DESC ROWS UNBOUNDED PRECEDING)) AS fdr
      FROM (SELECT *, {n} AS _n, row_number() OVER (ORDER BY {p}, {tie}) AS _k FROM {rows})"""


def u32(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


LINE_P = f"lp AS (SELECT {LINE_KEY_SQL} AS key, l_returnflag AS grp, l_extendedprice / 200000 AS p FROM lineitem)"

EVENTS = f"""
  pts AS (SELECT 'e' || event_id AS snp, event_type AS chr, epoch_us(ts) // 1000000 AS pos, value, user_id FROM events),
  reg AS (SELECT concat_ws('_u', chr, user_id) AS gene, chr, min(pos) AS s, min(pos) + 3600 AS e FROM pts GROUP BY chr, user_id),
  prs AS (SELECT snp, gene, pts.chr, pos, s, e, value FROM pts JOIN reg
          ON pts.chr = reg.chr AND pos BETWEEN s - {DISTANCE} AND e + {DISTANCE}),
  res AS (SELECT *, value AS beta, value / 10 AS t_stat, 1.0 / (1.0 + abs(value)) AS p_value,
                 least(1.0, 2 / (1.0 + abs(value))) AS fdr FROM prs),
  loc AS (SELECT *, CASE WHEN pos < s THEN pos - 1 ELSE s END AS st, CASE WHEN pos > e THEN pos ELSE e END AS en FROM res),
  uni AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chr, st, en ORDER BY p_value, snp, gene) AS rn FROM loc) WHERE rn = 1),
  sig AS (SELECT chr, b * 600 AS s, b * 600 + least(600, n * 150) AS e, v FROM
          (SELECT chr, pos // 600 AS b, count(*) AS n, sqrt(1 + avg(value)) AS v FROM pts GROUP BY 1, 2)),
  sm AS (SELECT chr, st, en, coalesce(sum(cov), 0) AS covered, coalesce(sum(cov * v), 0.0) AS total FROM
          (SELECT u.chr, st, en, v, CASE WHEN sig.s IS NOT NULL THEN least(en, sig.e) - greatest(st, sig.s) END AS cov FROM
             (SELECT DISTINCT chr, st, en FROM uni) u LEFT JOIN sig ON u.chr = sig.chr AND sig.s < en AND sig.e > st)
         GROUP BY chr, st, en),
  con AS (SELECT chr, pos // 1000 AS bin1, pos // 1000 + 3 + user_id % 3 AS bin2, round(sum(value), 4) AS v FROM pts GROUP BY 1, 2, 3),
  hic AS (SELECT u.*, CASE WHEN abs(en // 1000 - st // 1000) > 1 THEN coalesce(con.v, 0.0) END AS hic FROM uni u
          LEFT JOIN con ON con.chr = u.chr AND con.bin1 = st // 1000 AND con.bin2 = en // 1000),
  fea AS (SELECT snp || '-' || gene AS key, h.*, total / covered AS recomb, -log10(h.fdr) AS nl FROM hic h
          JOIN sm USING (chr, st, en) WHERE covered >= 1),
  tru AS (SELECT snp || '-' || gene AS key, p_value / 2 AS raw_p, p_value AS q, 1 AS line FROM res
          UNION ALL SELECT snp || '-' || gene, p_value / 3, p_value / 4, 2 FROM res WHERE beta > 20)
"""

RAW = """
  raw AS (SELECT l_returnflag AS chr, l_suppkey AS b1, l_partkey AS b2, count(*) AS c FROM lineitem GROUP BY 1, 2, 3),
  nrm AS (SELECT l_returnflag AS chr, l_partkey AS b, CASE WHEN min(l_discount) > 0 THEN avg(l_quantity) / 10 END AS v FROM lineitem GROUP BY 1, 2),
  exq AS (SELECT l_returnflag AS chr, l_partkey AS d, avg(l_tax) + 0.5 AS v FROM lineitem GROUP BY 1, 2),
  nor AS (SELECT raw.chr, b1, b2, c / (n1.v * n2.v) AS v FROM raw
          JOIN nrm n1 ON n1.chr = raw.chr AND n1.b = b1 AND n1.v IS NOT NULL
          JOIN nrm n2 ON n2.chr = raw.chr AND n2.b = b2 AND n2.v IS NOT NULL)
"""

VEC = """
  x AS (SELECT vec_id::VARCHAR AS id, i, embedding[i]::DOUBLE AS v FROM embeddings, generate_series(1, 64) g(i)),
  y AS (SELECT vec_id::VARCHAR AS id, i, embedding[65 - i]::DOUBLE AS v FROM embeddings, generate_series(1, 64) g(i))
"""
COV = ", c AS (SELECT i, avg(v) AS v FROM x GROUP BY i)"
PAIR = ", pr AS (SELECT x.id AS snp, y.id AS gene, corr(x.v, y.v) AS r, regr_slope(y.v, x.v) AS beta FROM x JOIN y USING (i) GROUP BY 1, 2)"
SPOTS = ", vl AS (SELECT vec_id::VARCHAR AS id, 'c' || label AS chr, vec_id * 1000 AS pos FROM embeddings)"


def t_of(r: str, df: int) -> str:
    return f"{r} * sqrt({df}.0 / (1.0 - {r} * {r}))"


def assoc(pairs: str, r: str, df: int, n: str = "count(*) OVER ()", where: str = "true", head: str = "") -> str:
    """Association output from a relation with snp, gene, beta and the partial correlation r."""
    tested = f"(SELECT snp, gene, beta, {t_of(r, df)} AS t_stat FROM {pairs})"
    with_p = f"(SELECT *, {t_tail('t_stat', df)} AS p_value FROM {tested})"
    return f"""WITH {head}, tst AS (SELECT *, count(*) OVER () AS _all FROM {with_p}),
      adj AS ({bh(f"(SELECT * FROM tst WHERE {where})", "p_value", n)})
      SELECT snp, gene, round(beta, 6) AS beta, round(t_stat, 6) AS t_stat, round(p_value, 6) AS p_value, round(fdr, 6) AS fdr FROM adj"""


def near_sql(op: str) -> str:
    """Variant-trait pairs with embedding locations; ``op`` is '' for near pairs, 'NOT' for the rest."""
    return f"""(SELECT pr.* FROM pr JOIN vl a ON a.id = snp JOIN vl b ON b.id = gene
      WHERE {op} (a.chr = b.chr AND a.pos BETWEEN b.pos + 200 - 20000 AND b.pos + 700 + 20000))"""


def downsample_sql() -> str:
    """Each draw tested on its own: vectors restricted to its positions, locations to the chromosomes."""
    chroms = ", ".join(f"'{c}'" for c in DRAW_CHROMS)
    spots = SPOTS.replace("FROM embeddings", f"FROM embeddings WHERE 'c' || label IN ({chroms})")
    blocks = []
    for name, at in draws(SAMPLES, DRAWS).items():
        own = VEC.replace("g(i))", f"g(i) WHERE i IN ({', '.join(str(i + 1) for i in at)}))")
        for kind, op, n, p in (("cis", "", "_all", 0.5), ("trans", "NOT", "_all", 0.01)):
            tested = assoc(near_sql(op), "r", len(at) - 2, n=n, where=f"p_value <= {p}", head=own + PAIR + spots)
            blocks.append(f"SELECT '{name}' AS subset, '{kind}' AS kind, * FROM ({tested})")
    return " UNION ALL ".join(blocks)


# Cells that with_gaps leaves, and row means in the gaps, as the engine fills them.
GAPS = """
  x0 AS (SELECT id, i, v FROM x WHERE (i - 1 + id::BIGINT) % 7 <> 0), y0 AS (SELECT id, i, v FROM y WHERE (i - 1 + id::BIGINT) % 11 <> 0),
  xf AS (SELECT x.id, x.i, coalesce(x0.v, m.v) AS v FROM x JOIN (SELECT id, avg(v) AS v FROM x0 GROUP BY 1) m USING (id) LEFT JOIN x0 ON x0.id = x.id AND x0.i = x.i),
  yf AS (SELECT y.id, y.i, coalesce(y0.v, m.v) AS v FROM y JOIN (SELECT id, avg(v) AS v FROM y0 GROUP BY 1) m USING (id) LEFT JOIN y0 ON y0.id = y.id AND y0.i = y.i)"""
THREE = """
  c3 AS (SELECT i, avg(v) AS c, avg(v) FILTER (WHERE label % 2 = 0) AS a, avg(v) FILTER (WHERE vec_id % 3 = 0) AS b
         FROM x JOIN embeddings ON vec_id::VARCHAR = id GROUP BY i)"""


def interaction_sql() -> str:
    """Gram-Schmidt by hand: the basis 1, a, b, c, then the variant, then the product; the trait on what is left of the product."""
    return f"""WITH {VEC}, {GAPS}, {THREE},
      k1 AS (SELECT i, a - avg(a) OVER () AS a1, b - avg(b) OVER () AS b0, c - avg(c) OVER () AS c0, a FROM c3),
      k2 AS (SELECT *, b0 - a1 * sum(b0 * a1) OVER () / sum(a1 * a1) OVER () AS b1 FROM k1),
      k3 AS (SELECT *, c0 - a1 * sum(c0 * a1) OVER () / sum(a1 * a1) OVER () - b1 * sum(c0 * b1) OVER () / sum(b1 * b1) OVER () AS c1 FROM k2),
      kk AS (SELECT *, sum(a1 * a1) OVER () AS qa, sum(b1 * b1) OVER () AS qb, sum(c1 * c1) OVER () AS qc FROM k3),
      xz AS (SELECT id, i, v, v * a AS z, a1, b1, c1, qa, qb, qc FROM xf JOIN kk USING (i)),
      x1 AS (SELECT id, i, a1, b1, c1, {_cleared('v')} AS v1, {_cleared('z')} AS z1 FROM xz WINDOW w AS (PARTITION BY id)),
      x2 AS (SELECT id, i, v1, z1 - v1 * sum(z1 * v1) OVER w / sum(v1 * v1) OVER w AS z2 FROM x1 WINDOW w AS (PARTITION BY id)),
      y1 AS (SELECT id, i, {_cleared('v')} AS v1 FROM yf JOIN kk USING (i) WINDOW w AS (PARTITION BY id)),
      s AS (SELECT x2.id AS snp, y1.id AS gene, sum(x2.z2 * y1.v1) AS zy, sum(x2.z2 * x2.z2) AS zz, sum(x2.v1 * y1.v1) AS xy, sum(x2.v1 * x2.v1) AS xx, sum(y1.v1 * y1.v1) AS yy
            FROM x2 JOIN y1 USING (i) GROUP BY 1, 2)
      SELECT snp, gene, round(zy / zz, 6) AS beta, round(zy / zz / sqrt((yy - xy * xy / xx - zy * zy / zz) / 58.0 / zz), 6) AS t_stat FROM s"""


def _cleared(v: str) -> str:
    return f"{v} - avg({v}) OVER w - a1 * sum({v} * a1) OVER w / qa - b1 * sum({v} * b1) OVER w / qb - c1 * sum({v} * c1) OVER w / qc"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["bh_fdr"] = f"WITH {LINE_P}, a AS ({bh('lp', 'p', tie='key')}) SELECT key, round(p, 8) AS p, round(fdr, 8) AS fdr FROM a"
    q["bh_fdr_log10p"] = f"""WITH {LINE_P}, a AS ({bh('lp', 'p', tie='key')})
      SELECT key, round(-log10(p), 8) AS neg_log10_p, round(fdr, 8) AS fdr FROM a"""
    q["bh_fdr_by_group"] = f"""WITH {LINE_P}, k AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n,
        row_number() OVER (PARTITION BY grp ORDER BY p, key) AS rk FROM lp)
      SELECT key, grp, round(p, 8) AS p, round(least(1.0, min(n * p / rk) OVER
        (PARTITION BY grp ORDER BY p DESC, rk DESC ROWS UNBOUNDED PRECEDING)), 8) AS fdr FROM k"""
    q["bh_fdr_flagged"] = f"""WITH {LINE_P}, a AS ({bh('lp', 'p', n='1000000', tie='key')})
      SELECT key, round(fdr, 4) AS fdr, CAST(fdr <= 0.5 AS INT) AS significant FROM a"""
    q["pvalue_transforms"] = f"""SELECT {LINE_KEY_SQL} AS key, round(-log10(l_extendedprice / 200000), 8) AS neg_log10_p,
      round(power(10, -l_tax), 8) AS p_of_tax FROM lineitem"""

    q["assoc_linear"] = assoc("pr", "r", 62, head=VEC + PAIR)
    q["assoc_all_pairs_pruned"] = assoc("pr", "r", 62, n="_all", where="p_value <= 0.001", head=VEC + PAIR)
    q["assoc_linear_cov"] = assoc(
        "pc", "rp", 61,
        head=VEC + COV + PAIR + """,
        xs AS (SELECT x.id AS snp, corr(x.v, c.v) AS rxc, stddev_pop(x.v) AS sx FROM x JOIN c USING (i) GROUP BY 1),
        ys AS (SELECT y.id AS gene, corr(y.v, c.v) AS ryc, stddev_pop(y.v) AS sy FROM y JOIN c USING (i) GROUP BY 1),
        pt AS (SELECT pr.snp, pr.gene, (r - rxc * ryc) / sqrt((1 - rxc * rxc) * (1 - ryc * ryc)) AS rp,
                 sy * sqrt(1 - ryc * ryc) AS sry, sx * sqrt(1 - rxc * rxc) AS srx
               FROM pr JOIN xs USING (snp) JOIN ys USING (gene)),
        pc AS (SELECT snp, gene, rp, rp * sry / srx AS beta FROM pt)""",
    )
    q["assoc_interaction"] = assoc(
        "pi", "rp", 60,
        head=VEC + COV + PAIR + """,
        z AS (SELECT x.id, i, x.v * c.v AS v FROM x JOIN c USING (i)),
        xs AS (SELECT x.id AS snp, corr(x.v, c.v) AS rxc, corr(z.v, c.v) AS rzc, corr(z.v, x.v) AS rzx, stddev_pop(z.v) AS sz
               FROM x JOIN c USING (i) JOIN z ON z.id = x.id AND z.i = x.i GROUP BY 1),
        ys AS (SELECT y.id AS gene, corr(y.v, c.v) AS ryc, stddev_pop(y.v) AS sy FROM y JOIN c USING (i) GROUP BY 1),
        zy AS (SELECT z.id AS snp, y.id AS gene, corr(z.v, y.v) AS rzy FROM z JOIN y USING (i) GROUP BY 1, 2),
        p1 AS (SELECT snp, gene, sz, sy, rzc, ryc,
                 (r - rxc * ryc) / sqrt((1 - rxc * rxc) * (1 - ryc * ryc)) AS yx,
                 (rzy - rzc * ryc) / sqrt((1 - rzc * rzc) * (1 - ryc * ryc)) AS yz,
                 (rzx - rzc * rxc) / sqrt((1 - rzc * rzc) * (1 - rxc * rxc)) AS zx
               FROM pr JOIN xs USING (snp) JOIN ys USING (gene) JOIN zy USING (snp, gene)),
        p2 AS (SELECT *, (yz - yx * zx) / sqrt((1 - yx * yx) * (1 - zx * zx)) AS rp FROM p1),
        pi AS (SELECT snp, gene, rp, rp * sy * sqrt((1 - ryc * ryc) * (1 - yx * yx)) / (sz * sqrt((1 - rzc * rzc) * (1 - zx * zx))) AS beta FROM p2)""",
    )
    q["assoc_cis"] = assoc(near_sql(""), "r", 62, head=VEC + PAIR + SPOTS)
    q["assoc_trans"] = assoc(near_sql("NOT"), "r", 62, n="_all", where="p_value <= 0.01", head=VEC + PAIR + SPOTS)
    q["assoc_trans_tight"] = assoc(near_sql("NOT"), "r", 62, n="_all", where="p_value <= 1e-4", head=VEC + PAIR + SPOTS)
    q["assoc_covariates"] = interaction_sql()
    q["downsample_assoc"] = downsample_sql()
    q["assoc_complete_cells"] = f"""WITH {VEC + PAIR + SPOTS} SELECT snp, gene, 64 AS n, round(r, 6) AS r, round(beta, 6) AS beta,
      round({t_of('r', 62)}, 6) AS t_stat FROM {near_sql('')}"""
    q["assoc_pvalue"] = f"SELECT {LINE_KEY_SQL} AS key, round({t_tail('((l_quantity - 25) / 5)', 10)}, 8) AS p_value FROM lineitem"

    q["cis_pairs"] = f"WITH {EVENTS} SELECT snp, gene, chr, pos, s AS start, e AS \"end\" FROM prs"
    q["region_filter"] = f"WITH {EVENTS} SELECT snp, chr, pos FROM pts WHERE chr = 'click' AND pos BETWEEN 1704500000 AND 1705500000"
    q["pair_span"] = f"""WITH {EVENTS} SELECT chr, st AS start, en AS "end", snp, gene, round(beta, 6) AS beta, round(t_stat, 6) AS t_stat,
      round(p_value, 8) AS p_value, round(fdr, 8) AS fdr FROM loc"""
    q["pair_beds"] = f"""WITH {EVENTS} SELECT 'snp' AS kind, chr, pos - 1 AS start, pos AS "end", format('{{}}:{{}}-{{}}', chr, st, en) AS name, snp, gene FROM loc
      UNION ALL SELECT 'gene', chr, s, e, format('{{}}:{{}}-{{}}', chr, st, en), snp, gene FROM loc"""
    q["dedup_first"] = f"WITH {EVENTS} SELECT chr, st AS start, en AS \"end\", snp, gene, round(p_value, 8) AS p_value FROM uni"
    q["dedup_first_line"] = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM
      (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1"""
    q["dedup_adjacent"] = """SELECT event_id, event_type, user_id FROM (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS prev FROM events)
      WHERE prev IS NULL OR prev <> event_type"""
    q["overlap_pairs"] = f"""WITH {EVENTS} SELECT reg.gene, reg.chr, reg.s AS start, reg.e AS "end", sig.s AS start2, sig.e AS end2,
      least(reg.e, sig.e) - greatest(reg.s, sig.s) AS overlap FROM reg JOIN sig ON reg.chr = sig.chr AND sig.s < reg.e AND reg.s < sig.e"""
    q["interval_signal"] = f"""WITH {EVENTS} SELECT chr, st AS start, en AS "end", en - st AS size, covered::BIGINT AS covered, round(total, 6) AS sum,
      round(total / (en - st), 6) AS mean0, round(CASE WHEN covered > 0 THEN total / covered END, 6) AS mean FROM sm"""
    q["interval_signal_mean0"] = f"""WITH {EVENTS} SELECT chr, st AS start, en AS "end",
      CASE WHEN covered >= 1000 THEN printf('%.3f', total / (en - st))::DOUBLE ELSE -1.0 END AS recomb FROM sm"""
    q["contact_lookup"] = f"WITH {EVENTS} SELECT chr, st AS start, en AS \"end\", snp, gene, hic FROM hic"
    q["contact_norm"] = f"WITH {RAW} SELECT chr, b1 AS bin1, b2 AS bin2, round(v, 8) AS value FROM nor"
    q["contact_oe"] = f"""WITH {RAW} SELECT nor.chr, b1 AS bin1, b2 AS bin2, round(nor.v / exq.v, 8) AS value FROM nor
      LEFT JOIN exq ON exq.chr = nor.chr AND exq.d = b2 - b1"""
    q["signal_oe"] = f"""WITH {EVENTS}, ob AS (SELECT chr, st, en, en - st AS len, CASE WHEN covered >= 1 THEN total / covered END AS o FROM sm),
      ex AS (SELECT chr, len, CASE WHEN count(*) = 1 THEN NULL WHEN count(*) = 2 THEN 0.0 ELSE avg(o) END AS e FROM ob GROUP BY 1, 2 HAVING count(*) <> 4)
      SELECT chr, st AS start, en AS "end", round(o, 6) AS observed, round(e, 6) AS expected,
        round(CASE WHEN o IS NULL OR e IS NULL THEN NULL WHEN e = 0 THEN 100.0 ELSE o / e END, 6) AS ratio, round(o - e, 6) AS difference
      FROM ob JOIN ex USING (chr, len)"""
    cell2 = r"'0/0:' || l_suppkey || ':CH:' || l_partkey || ':q'"
    q["vcf_methylation"] = f"""SELECT 'cg:chr' || l_returnflag || '-' || (l_orderkey * 10 + l_linenumber) AS id,
      printf('%.5f', floor(l_quantity) / (floor(l_quantity) + l_linenumber))::DOUBLE AS m1,
      CASE WHEN l_discount = 0 OR l_suppkey + l_partkey = 0 THEN NULL ELSE
        printf('%.5f', regexp_extract({cell2}, ':(\\d+):\\w+:(\\d+):', 1)::DOUBLE / (l_suppkey + l_partkey))::DOUBLE END AS m2,
      CAST(NULL AS DOUBLE) AS m3 FROM lineitem WHERE l_linestatus = 'F'"""
    q["vcf_methylation_cg"] = """SELECT 'cg:chr' || l_returnflag || '-' || (l_orderkey * 10 + l_linenumber) AS id,
      printf('%.5f', floor(l_quantity) / (floor(l_quantity) + l_linenumber))::DOUBLE AS m1,
      CAST(NULL AS DOUBLE) AS m2, CAST(NULL AS DOUBLE) AS m3 FROM lineitem WHERE l_linestatus = 'F'"""
    q["matrix_melt"] = "SELECT vec_id::VARCHAR AS id, 's' || (i - 1) AS sample, embedding[i]::DOUBLE AS value FROM embeddings, generate_series(1, 64) g(i)"
    q["matrix_subset"] = """WITH s AS (SELECT i FROM generate_series(0, 63) g(i) ORDER BY md5('2015:s' || i), 's' || i LIMIT 20),
      n AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM s)
      SELECT vec_id::VARCHAR AS id, CAST(k AS INT) AS sample, embedding[i + 1]::DOUBLE AS value FROM embeddings, n
      WHERE vec_id IN (SELECT doc_id FROM labels)"""
    q["feature_matrix"] = f"""WITH {EVENTS} SELECT key, round(nl, 8) AS neg_log10, hic, round(recomb, 6) AS recomb FROM fea"""
    q["class_counts"] = f"WITH {EVENTS} SELECT CAST(q < 0.05 AS INT) AS class, count(*) AS n FROM tru GROUP BY 1"
    q["training_set"] = f"""WITH {EVENTS}, lst AS (SELECT key, arg_max(raw_p, line) AS raw_p, arg_max(q, line) AS q FROM tru GROUP BY key),
      cc AS (SELECT sum(CAST(q < 0.05 AS INT)) AS n_pos, sum(CAST(q >= 0.05 AS INT)) AS n_neg FROM tru)
      SELECT key, round(nl, 8) AS neg_log10, hic, round(recomb, 6) AS recomb, round(-log10(raw_p), 8) AS label, CAST(q < 0.05 AS INT) AS class
      FROM fea JOIN lst USING (key), cc
      WHERE {u32('key', 12345)} / 4294967296.0 < CASE WHEN q < 0.05 THEN least(1.0, 400.0 / n_pos) ELSE least(1.0, 900.0 / n_neg) END"""
    q["pvalue_histogram"] = f"""WITH {LINE_P}, h AS (SELECT CAST(floor(-log10(p) * 10) AS INT) AS bin, count(*) AS n FROM lp GROUP BY 1)
      SELECT bin, bin / 10.0::DOUBLE AS neg_log10_low, n, CAST(sum(n) OVER (ORDER BY bin DESC) AS BIGINT) AS running,
        round(-log10(sum(n) OVER (ORDER BY bin DESC) / (sum(n) OVER () + 1)), 8) AS neg_log10_expected FROM h"""
    q["regression_metrics"] = """WITH t AS (SELECT l_returnflag AS grp, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS f FROM lineitem)
      SELECT grp, count(*) AS n, round(avg((y - f) * (y - f)), 6) AS mse, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse,
        round(1 - avg((y - f) * (y - f)) / var_pop(y), 6) AS r2, round(var_pop(f) + power(avg(f) - avg(y), 2), 6) AS explained_variance
      FROM t GROUP BY 1"""
    q["fold_summary"] = """WITH t AS (SELECT l_returnflag AS grp, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS f FROM lineitem),
      m AS (SELECT grp, avg((y - f) * (y - f)) AS mse, 1 - avg((y - f) * (y - f)) / var_pop(y) AS r2 FROM t GROUP BY 1)
      SELECT round(max(r2), 6) AS best_r2, round(arg_max(mse, r2), 6) AS best_mse, round(avg(mse), 6) AS mean_mse FROM m"""
    q["fold_split"] = f"SELECT {LINE_KEY_SQL} AS key, CAST({u32(LINE_KEY_SQL, 12345)} % 10 AS INT) AS fold FROM lineitem"
    q["train_valid_split"] = f"""SELECT {LINE_KEY_SQL} AS key, CAST({u32(LINE_KEY_SQL, 12345)} / 4294967296.0 < 0.1 AS INT) AS is_validation FROM lineitem"""
    q["run_counters"] = "SELECT count(*) AS total, count(DISTINCT l_orderkey) AS kept FROM lineitem"

    # Models whose answer is known.
    level = "CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.5 ELSE 4.0 END::DOUBLE"
    q["gbt_group_means"] = f"""SELECT {LINE_KEY_SQL} AS key, l_returnflag AS c, round(avg({level} + l_quantity % 7) OVER (PARTITION BY l_returnflag), 6) AS prediction FROM lineitem"""
    q["gbt_early_stop"] = f"""SELECT {LINE_KEY_SQL} AS key, {u32(LINE_KEY_SQL, 12345)} / 4294967296.0 < 0.1 AS is_validation, {level} AS prediction, true AS few_trees FROM lineitem"""
    q["rf_levels"] = f"SELECT {LINE_KEY_SQL} AS key, l_returnflag AS c, {level} AS prediction FROM lineitem"
    q["classes_by_category"] = f"""SELECT {LINE_KEY_SQL} AS key, 'is-' || l_returnflag AS forest, CASE WHEN l_returnflag = 'N' THEN 'new' ELSE 'old' END AS boosted FROM lineitem"""
    q["kfold_levels"] = f"""SELECT CAST({u32(LINE_KEY_SQL, 12345)} % 10 AS INT) AS fold, count(*) AS n, 0.0::DOUBLE AS mse, 1.0::DOUBLE AS r2 FROM lineitem GROUP BY 1"""
    q["importance_of_category"] = "SELECT * FROM (VALUES ('zero__v', 0.0::DOUBLE), ('zero__na', 0.0), ('c__i', 1.0)) v(feature, importance) WHERE EXISTS (FROM lineitem)"
    q["missing_is_a_value"] = f"SELECT {LINE_KEY_SQL} AS key, CASE l_returnflag WHEN 'R' THEN 4.0 ELSE 1.0 END::DOUBLE AS prediction FROM lineitem"
    q["model_round_trip"] = f"SELECT {LINE_KEY_SQL} AS key, l_quantity, true AS same FROM lineitem"
    q["detect_levels"] = f"""WITH p AS (SELECT {LINE_KEY_SQL} AS key, {level} AS prediction, power(10, -{level}) AS p FROM lineitem), a AS ({bh('p', 'p', tie='key')})
      SELECT key, prediction, round(fdr, 6) AS adjusted FROM a"""

    # Written and read back.
    q["io_columns"] = f"SELECT {LINE_KEY_SQL} AS \"I1\", l_quantity AS \"C2\", l_tax AS \"C3\", l_returnflag AS \"C4\", l_extendedprice AS label FROM lineitem"
    q["io_vectors"] = "SELECT l_quantity AS f1, l_tax AS f2, l_extendedprice AS label FROM lineitem"
    q["io_inferred"] = "SELECT p_partkey, p_brand, p_retailprice FROM part"
    q["io_matrix"] = q["matrix_melt"]
    q["io_locations"] = f"WITH {EVENTS} SELECT snp AS id, chr, pos AS start, pos AS \"end\" FROM pts UNION ALL SELECT gene, chr, s, e FROM reg"
    q["io_results"] = f"WITH {EVENTS} SELECT snp, gene, round(beta, 6) AS beta, round(t_stat, 6) AS t_stat, round(p_value, 8) AS p_value, round(fdr, 8) AS fdr FROM res"
    q["io_beds"] = q["pair_beds"] + f""" UNION ALL SELECT 'pair', chr, st, en, NULL, snp, gene FROM loc"""
    q["io_truth"] = f"WITH {EVENTS} SELECT snp || '-' || gene AS key, round(p_value, 8) AS raw_p, round(fdr, 8) AS fdr FROM res"
    q["io_permutation_summary"] = "SELECT l_returnflag AS chr, l_partkey AS len, round(max(l_tax), 6) AS expected FROM lineitem GROUP BY 1, 2"
    q["io_sparse_contacts"] = "SELECT 'A' AS chr, l_suppkey AS bin1, l_partkey AS bin2, max(l_extendedprice) AS value FROM lineitem GROUP BY 2, 3"
    q["io_dense_contacts"] = """SELECT 'E' AS chr, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS r, embedding AS m FROM embeddings"""
    q["io_dense_contacts"] = f"""SELECT chr, r AS bin1, i - 1 AS bin2, round(m[i]::DOUBLE, 6) AS value FROM ({q['io_dense_contacts']}), generate_series(1, 64) g(i)
      WHERE round(m[i]::DOUBLE, 6) > 0"""
    q["io_bin_vector"] = """SELECT 'P' AS chr, row_number() OVER (ORDER BY p_partkey) AS idx, p_retailprice AS value FROM part"""
    q["io_bin_vector"] = f"SELECT p.* FROM ({q['io_bin_vector']}) p JOIN (SELECT row_number() OVER (ORDER BY p_partkey) AS idx, p_size FROM part) s USING (idx) WHERE p_size <> 1"
    q["io_triplets"] = "SELECT 'A' AS chr, l_suppkey * 1000 AS pos1, l_partkey * 1000 AS pos2, count(*)::DOUBLE AS count FROM lineitem GROUP BY 2, 3"
    q["io_signal"] = f"WITH {EVENTS} SELECT chr, s AS start, e AS \"end\", round(v, 6) AS value FROM sig"
    q["io_vcf"] = q["vcf_methylation"].replace("AS m2", "AS m2x").replace("CAST(NULL AS DOUBLE) AS m3", "1 AS mx")
    q["io_vcf"] = f"SELECT id, m2x AS m1, CAST(NULL AS DOUBLE) AS m2 FROM ({q['io_vcf']})"
    q["io_scored"] = f"SELECT {LINE_KEY_SQL} AS key, CASE WHEN l_discount > 0.02 THEN l_discount END AS hic, l_tax AS prediction FROM lineitem"
    q["io_predictions"] = "SELECT l_quantity AS f0, l_tax AS f1, l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem"
    q["io_fdr"] = q["bh_fdr"]
    q["io_by_chromosome"] = f"WITH {EVENTS} SELECT snp, chr, pos FROM pts"
    q["io_matrix_by_chromosome"] = """SELECT 'c' || label AS chr, vec_id::VARCHAR AS id, 's' || (i - 1) AS sample,
      CASE WHEN (i - 1 + vec_id) % 7 <> 0 THEN embedding[i]::DOUBLE END AS value FROM embeddings, generate_series(1, 64) g(i)"""
    q["io_covariates"] = f"""WITH {VEC}, {THREE}, u AS (UNPIVOT c3 ON c, a, b INTO NAME id VALUE value)
      SELECT id, CASE id WHEN 'c' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS place, CAST(i - 1 AS INT) AS i, round(value, 6) AS value FROM u"""
    q["io_contacts"] = f"WITH {RAW} SELECT chr, b1 AS bin1, b2 AS bin2, round(v, 8) AS value FROM nor"
    parts = [(kind, assoc(near_sql(op), "r", 62, n="_all", where=f"p_value <= {p}", head=VEC + PAIR + SPOTS)) for kind, op, p in (("cis", "", 1.0), ("trans", "NOT", 0.001))]
    q["io_cis_trans"] = " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM ({sql})" for kind, sql in parts)
    return q
