"""Plain SQL with the results of the core's queries."""

from __future__ import annotations

from linkwright.plans.queries import EXAMPLE_START, VOTER_FIELDS, VOTER_START


def _scored(pairs: str) -> str:
    """Common table expressions that give ``y(a, b, s)`` for a relation of string pairs ``a, b``."""
    return f"""
prs AS ({pairs}),
u AS (SELECT a, b, length(a) n, length(b) m,
        list_reduce(range(1, length(a)+1), lambda acc, i: list_append(acc, coalesce(list_filter(
          range(greatest(1, i-(greatest(length(a),length(b))//2-1)),
                least(length(b), i+(greatest(length(a),length(b))//2-1))+1),
          lambda j: a[i]=b[j] AND NOT list_contains(acc, j))[1], 0)), []::BIGINT[]) um FROM prs),
v AS (SELECT *, list_filter(range(1, n+1), lambda i: um[i]>0) si,
             list_sort(list_filter(um, lambda j: j>0)) tj FROM u),
w AS (SELECT a, b, n, m, len(si) c,
        len(list_filter(range(1, len(si)+1), lambda k: a[si[k]]<>b[tj[k]])) t,
        CASE WHEN a[1]<>b[1] THEN 0 WHEN a[2]<>b[2] THEN least(1,n,m)
             WHEN a[3]<>b[3] THEN least(2,n,m) WHEN a[4]<>b[4] THEN least(3,n,m)
             ELSE least(4,n,m) END l FROM v),
x AS (SELECT *, CASE WHEN c=0 THEN 0::FLOAT ELSE
        ((((c::FLOAT/n::FLOAT)+(c::FLOAT/m::FLOAT))
          +((c::FLOAT-(t::FLOAT/2::FLOAT))/c::FLOAT))::DOUBLE/3.0::DOUBLE)::FLOAT END d FROM w),
y AS (SELECT a, b, CASE WHEN d=0 THEN 0::FLOAT
        ELSE d+(0.1::FLOAT*l::FLOAT)*(1::FLOAT-d) END s FROM x)"""


_LEVEL = "CASE WHEN s >= 0.94::FLOAT THEN 2 WHEN s >= 0.88::FLOAT THEN 1 ELSE 0 END"
_NAMES = "SELECT a.p_name a, b.p_name b FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b"

# dedup of part: levels of names between distinct values, larger first, equal ones at level 2
_DEDUP = f"""WITH {_scored(_NAMES)},
lv AS (SELECT a, b, CASE WHEN a = b THEN 2 ELSE {_LEVEL} END AS level FROM y),
pp AS (SELECT a.p_partkey idx_a, b.p_partkey idx_b, 2 * lv.level + (a.p_type = b.p_type)::INT AS pattern_id, lv.level
       FROM part a JOIN part b ON a.p_partkey > b.p_partkey
       JOIN lv ON lv.a = greatest(a.p_name, b.p_name) AND lv.b = least(a.p_name, b.p_name))
"""

_LINK = f"""WITH {_scored("SELECT a.n_name a, b.n_name b FROM nation a, nation b")},
lv AS (SELECT a, b, {_LEVEL} AS level FROM y),
aa AS (SELECT s_suppkey i, n_name, n_nationkey k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
bb AS (SELECT c_custkey j, n_name, n_nationkey k FROM customer JOIN nation ON c_nationkey = n_nationkey),
pp AS (SELECT i AS idx_a, j AS idx_b, 2 * level + (aa.k = bb.k)::INT AS pattern_id
       FROM aa, bb JOIN lv ON TRUE WHERE lv.a = aa.n_name AND lv.b = bb.n_name)
"""



def _em(points: str, levels: list[int], start: tuple) -> str:
    """Expectation-maximisation over ``pt(id, g0, g1, ..., cnt)``; ends in ``ks(id, cnt, lam, k)``, its state is ``fin``."""
    n = range(len(levels))
    vector = lambda v: "[" + ",".join(map(str, v)) + "]::DOUBLE[]"
    match = "lam*" + "*".join(f"q{i}[g{i}+1]" for i in n)
    other = "(1-lam)*" + "*".join(f"p{i}[g{i}+1]" for i in n)
    share = f"{match} / ({match} + {other})"
    new = lambda c, w: ",\n".join("[" + ", ".join(f"sum(CASE WHEN g{i}={l} THEN {w}*cnt ELSE 0 END)/sum({w}*cnt)" for l in range(levels[i])) + f"] AS n{c}{i}" for i in n)  # noqa: E731, E741
    state = ", ".join([*(f"p{i}" for i in n), *(f"q{i}" for i in n)])
    after = ", ".join([*(f"np{i}" for i in n), *(f"nq{i}" for i in n)])
    return f"""WITH RECURSIVE {points},
em(it, delta, lam, {state}) AS (
  SELECT 0, 1.0::DOUBLE, 0.1::DOUBLE, {", ".join([vector(v) for v in start[0]] + [vector(v) for v in start[1]])}
  UNION ALL
  SELECT it + 1, list_max(list_transform(list_zip({after.replace(", ", " || ")}, {state.replace(", ", " || ")}), lambda z: abs(z[1] - z[2]))), nlam, {after} FROM (
    SELECT it, {state}, sum(k*cnt)/sum(cnt) AS nlam, {new("p", "(1-k)")}, {new("q", "k")}
    FROM (SELECT em.*, pt.*, {share} AS k FROM em, pt WHERE delta >= 1e-4 AND it < 5000)
    GROUP BY it, {state})),
fin AS (SELECT * FROM em ORDER BY it DESC LIMIT 1),
ks AS (SELECT id, cnt, lam, {share} AS k FROM fin, pt)
"""


def _params(levels: list[int]) -> str:
    n = range(len(levels))
    rows = [f"SELECT {c} AS class, {i} AS variable, {l} AS level, round({v}{i}[{l + 1}], 4) AS prob FROM fin" for c, v in ((0, "p"), (1, "q")) for i in n for l in range(levels[i])]  # noqa: E741
    return "SELECT -1 AS class, -1 AS variable, -1 AS level, round(lam, 4) AS prob FROM fin UNION ALL " + " UNION ALL ".join(rows)


_EM = _em("pt(id, g0, g1, cnt) AS (VALUES (0,0,0,9000.0::DOUBLE),(1,0,1,150.0),(2,1,0,120.0),(3,1,1,60.0),(4,2,0,40.0),(5,2,1,630.0))", [3, 2], EXAMPLE_START)

_CURVE = """, grid AS (SELECT range / 1000.0::DOUBLE AS s FROM range(1001)),
cv AS (SELECT s, sum(CASE WHEN k >= s THEN (1-k)*cnt ELSE 0 END) AS wrong, sum(CASE WHEN k >= s THEN cnt ELSE 0 END) AS linked,
              sum(CASE WHEN k < s THEN k*cnt ELSE 0 END) AS missed, any_value(lam) AS lam, sum(cnt) AS n FROM grid, ks GROUP BY s),
fr AS (SELECT s, CASE WHEN linked > 0 THEN wrong/linked END AS fdr, missed/(lam*n) AS fnr, missed/lam*n AS odd FROM cv)
"""

# The engine's own similarity works on bytes and halves transpositions, hence the wide margin; it only bounds the pairs to be scored.
_NEAR = " UNION ".join(f"SELECT x.v a, z.v b FROM (SELECT DISTINCT {c} v FROM df_a WHERE {c} <> '') x, (SELECT DISTINCT {c} v FROM df_b WHERE {c} <> '') z WHERE jaro_winkler_similarity(x.v, z.v) >= 0.6" for c in VOTER_FIELDS)


def _voters(condition: str, year: bool = True) -> str:
    """``vp(i, j, pattern_id)`` of the pairs of voter records under a condition on ``a`` and ``b``."""
    levels = " + ".join(f"{w} * coalesce(l{k}.level, 0)" for k, w in enumerate((27, 9, 3, 1)))
    pattern = f"2 * ({levels}) + coalesce((a.birth_year = b.birth_year)::INT, 0)" if year else levels
    joins = " ".join(f"LEFT JOIN vl l{k} ON l{k}.a = a.{c} AND l{k}.b = b.{c}" for k, c in enumerate(VOTER_FIELDS))
    return f"""{_scored(_NEAR)}, vl AS (SELECT a, b, {_LEVEL} AS level FROM y WHERE s >= 0.88::FLOAT),
vp AS (SELECT a.idx i, b.idx j, {pattern} AS pattern_id FROM df_a a JOIN df_b b ON {condition} {joins})"""


def _voter_counts(n: int) -> str:
    return f"SELECT r.range::INT AS pattern_id, coalesce(c.n, 0)::BIGINT AS count FROM range({n}) r LEFT JOIN (SELECT pattern_id, count(*) n FROM vp GROUP BY 1) c ON c.pattern_id = r.range"


_LEVELS = [3, 3, 3, 3, 2]
_DIGITS = ", ".join(f"(pattern_id // {w} % {n})::INT" for w, n in zip((54, 18, 6, 2, 1), _LEVELS))
_VOTER_EM = _em(f"{_voters('TRUE')}, vc AS ({_voter_counts(162)}), pt(id, g0, g1, g2, g3, g4, cnt) AS MATERIALIZED (SELECT pattern_id, {_DIGITS}, count::DOUBLE FROM vc)", _LEVELS, VOTER_START)
_ROWS = lambda cols: ", ".join([*(f'a.{c} AS "{c}_A"' for c in cols), 'a.idx AS "Index_A"', 'b.idx AS "Index_B"', *(f'b.{c} AS "{c}_B"' for c in cols)])
_LINKED = lambda cols, condition: f"WITH {_voters(condition)} SELECT {_ROWS(cols)}, ksi FROM vp JOIN ksi USING (pattern_id) JOIN df_a a ON a.idx = i JOIN df_b b ON b.idx = j WHERE pattern_id > 0 AND ksi >= 0.85"
_ALL = ["idx", *VOTER_FIELDS, "birth_year", "gender", "ncid"]

_SETS = """WITH x AS (SELECT a.s_suppkey idx_a, b.s_suppkey idx_b FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey AND a.s_nationkey = b.s_nationkey),
y AS (SELECT a.s_suppkey idx_a, b.s_suppkey idx_b FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey AND sign(a.s_acctbal) = sign(b.s_acctbal))
"""

_BLOCKED = f"""WITH {_scored("SELECT a.g a, b.g b FROM (SELECT DISTINCT c_mktsegment g FROM customer) a, (SELECT DISTINCT c_mktsegment g FROM customer) b")},
lv AS (SELECT a, b, CASE WHEN a = b THEN 2 ELSE {_LEVEL} END AS level FROM y),
pp AS (SELECT 2 * level + (a.c_acctbal = b.c_acctbal)::INT AS pattern_id FROM customer a JOIN customer b ON a.c_custkey > b.c_custkey AND a.c_nationkey = b.c_nationkey
       JOIN lv ON lv.a = greatest(a.c_mktsegment, b.c_mktsegment) AND lv.b = least(a.c_mktsegment, b.c_mktsegment)),
t AS (SELECT sum(n * (n + 1) // 2)::BIGINT AS total FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)),
c AS (SELECT pattern_id, count(*) AS n FROM pp WHERE pattern_id > 0 GROUP BY 1)
SELECT range::INT AS pattern_id, CASE WHEN range = 0 THEN (SELECT total FROM t) - (SELECT coalesce(sum(n), 0)::BIGINT FROM c) ELSE coalesce(n, 0) END AS count
FROM range(6) LEFT JOIN c ON pattern_id = range
"""

_HARD = """SELECT a.last_name, a.first_name, a.house_number, a.street_name, a.birth_year, a.idx AS idx_a, a.gender AS gender_a, b.idx AS idx_b, b.gender AS gender_b
FROM df_a a JOIN df_b b USING (last_name, first_name, house_number, street_name, birth_year)"""

_P4 = """
SELECT 'last_name' AS field_name, last_name AS key_value FROM df_a WHERE last_name IS NOT NULL GROUP BY last_name
HAVING count(*) >= 0.03 * (SELECT count(*) FROM df_a)
UNION ALL
SELECT 'birth_year', birth_year::VARCHAR FROM df_a WHERE birth_year IS NOT NULL GROUP BY birth_year
HAVING count(*) >= 0.03 * (SELECT count(*) FROM df_a)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "jw_similarity_pairs": f"WITH {_scored(_NAMES)} SELECT a, b, round(s, 5)::DOUBLE AS similarity, {_LEVEL} AS level FROM y",
        "jw_unique_levels": f"WITH {_scored(_NAMES)} SELECT a AS v, b AS w, {_LEVEL} AS level FROM y WHERE s >= 0.88::FLOAT",
        "jw_link_levels": f"WITH {_scored('SELECT a.p_name a, b.g b FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT lower(c_mktsegment) g FROM customer) b')} SELECT CASE WHEN s >= 0.5::FLOAT THEN 2 ELSE 1 END AS level, sum(p.n * c.n)::BIGINT AS n_pairs FROM y JOIN (SELECT p_name, count(*) n FROM part GROUP BY 1) p ON p_name = a JOIN (SELECT lower(c_mktsegment) g, count(*) n FROM customer GROUP BY 1) c ON g = b WHERE s >= 0.4::FLOAT GROUP BY 1",
        "exact_pairs_by_nation": "SELECT c_custkey AS idx_a, s_suppkey AS idx_b FROM customer JOIN supplier ON c_nationkey = s_nationkey",
        "jw_dedup_levels": _DEDUP + "SELECT level, count(*) AS n_pairs, sum(idx_a - idx_b)::BIGINT AS sum_gap FROM pp WHERE level > 0 GROUP BY level",
        "exact_dedup_pairs": _SETS + "SELECT * FROM x",
        "intersect_of_pairs": _SETS + "SELECT * FROM x INTERSECT SELECT * FROM y",
        "setdiff_of_pairs": _SETS + "SELECT * FROM x EXCEPT SELECT * FROM y",
        "union_of_pairs": _SETS + "SELECT * FROM x UNION SELECT * FROM y",
        "link_indices": _LINK + "SELECT * FROM pp WHERE pattern_id > 0",
        "link_counts": _LINK + "SELECT range::INT AS pattern_id, count(idx_a) AS count FROM range(6) LEFT JOIN pp ON pattern_id = range GROUP BY range",
        "dedup_indices": _DEDUP + "SELECT idx_a, idx_b, pattern_id FROM pp WHERE pattern_id > 0",
        "dedup_counts": _DEDUP + ", c AS (SELECT pattern_id, count(*) AS n FROM pp GROUP BY 1) SELECT range::INT AS pattern_id, coalesce(n, 0) + CASE WHEN range = 0 THEN (SELECT count(*) FROM part) ELSE 0 END AS count FROM range(6) LEFT JOIN c ON pattern_id = range",
        "gamma_of_example": "SELECT pattern_id, gamma FROM ksi",
        "em_params": _EM + _params([3, 2]),
        "em_ksi": _EM + "SELECT id AS pattern_id, round(k, 4) AS ksi FROM ks",
        "dedup_linked": "SELECT a.s_suppkey AS \"s_suppkey_A\", a.s_name AS \"s_name_A\", a.s_nationkey AS \"s_nationkey_A\", a.s_suppkey AS \"Index_A\", b.s_suppkey AS \"Index_B\", b.s_suppkey AS \"s_suppkey_B\", b.s_name AS \"s_name_B\", b.s_nationkey AS \"s_nationkey_B\" FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey AND a.s_nationkey = b.s_nationkey",
        "hard_merge": _HARD,
        "overlap_count": "SELECT count(*) AS n_common FROM (SELECT last_name, first_name FROM df_a INTERSECT SELECT last_name, first_name FROM df_b)",
        "hard_merge_accuracy": f"WITH h AS ({_HARD}) SELECT round(avg(coalesce((gender_a = gender_b)::INT, 0)), 6) AS precision, round(sum(coalesce((gender_a = gender_b)::INT, 0)) / (SELECT count(*) FROM (SELECT gender FROM df_a INTERSECT SELECT gender FROM df_b) WHERE gender IS NOT NULL), 6) AS recall FROM h",
        "linked_rows": _LINKED(_ALL, "TRUE"),
        "linked_rows_by_year": _LINKED(["idx", "birth_year", *VOTER_FIELDS], "a.birth_year = b.birth_year"),
        "voter_accuracy": f"WITH h AS ({_LINKED(_ALL, 'TRUE')}), n AS (SELECT count(*) n FROM (SELECT ncid FROM df_a INTERSECT SELECT ncid FROM df_b) WHERE ncid IS NOT NULL) SELECT round(avg(coalesce((\"ncid_A\" = \"ncid_B\")::INT, 0)), 6) AS precision, round(sum(coalesce((\"ncid_A\" = \"ncid_B\")::INT, 0)) / nullif((SELECT n FROM n), 0), 6) AS recall FROM h",
        "voter_counts": f"WITH {_voters('a.birth_year = b.birth_year', False)} {_voter_counts(81)}",
        "voter_all_counts": f"WITH {_voters('TRUE')} {_voter_counts(162)}",
        "voter_em_params": _VOTER_EM + _params(_LEVELS),
        "voter_ksi": _VOTER_EM + "SELECT id AS pattern_id, round(k, 3) AS ksi FROM ks",
        "voter_linked": _VOTER_EM + 'SELECT i AS "Index_A", j AS "Index_B", a.last_name AS "last_name_A", b.last_name AS "last_name_B", a.birth_year AS "birth_year_A", b.birth_year AS "birth_year_B" FROM vp JOIN ks ON id = pattern_id JOIN df_a a ON a.idx = i JOIN df_b b ON b.idx = j WHERE id > 0 AND k >= 0.85',
        "voter_frontier": _VOTER_EM + _CURVE + "SELECT s, round(coalesce(fdr, -1), 3) AS fdr, round(fnr, 3) AS fnr FROM fr",
        "voter_threshold": _VOTER_EM + _CURVE + "SELECT arg_min(s, (coalesce(fdr + fnr, 2), s)) AS s FROM fr",
        "fdr_fnr_frontier": _EM + _CURVE + "SELECT s, round(coalesce(fdr, -1), 4) AS fdr, round(fnr, 4) AS fnr FROM fr",
        "optimal_threshold": _EM + _CURVE + "SELECT FALSE AS compat, arg_min(s, (coalesce(fdr + fnr, 2), s)) AS s FROM fr UNION ALL SELECT TRUE, arg_min(s, (coalesce(fdr + odd, 2), s)) FROM fr",
        "blocked_counts": _BLOCKED,
        "added_counts": _BLOCKED,
        "indexed_rows": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders",
        "p4_found": _P4,
        "p4_by_last_name": "SELECT last_name, count(*) AS n_rows, count(DISTINCT first_name) AS n_first_names, min(birth_year) AS first_year, max(birth_year) AS last_year FROM df_a WHERE last_name IS NOT NULL GROUP BY last_name",
        "p4_join_by_birth_year": "SELECT a.idx, a.birth_year, s.n_year, s.n_last_names FROM df_a a JOIN (SELECT birth_year, count(*) AS n_year, count(DISTINCT last_name) AS n_last_names FROM df_a GROUP BY birth_year) s ON a.birth_year = s.birth_year",
    }
