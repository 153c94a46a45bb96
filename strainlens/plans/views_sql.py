"""The stand-in views as SQL, for the agreement check."""
from __future__ import annotations

from strainlens.plans import views

_CASE_LABEL = "CASE WHEN o_orderkey % 10 < 4 THEN 0 WHEN o_orderkey % 10 < 7 THEN 1 WHEN o_orderkey % 10 < 9 THEN 2 ELSE 3 END"
_REGION_VALUES = ", ".join(
    "('{}', {}, {}, {})".format(n.replace("'", "''"), o, s, e) for n, o, s, e in views.region_rows()
)

# view -> (views it needs, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "meta0": ((), f"""
        SELECT o_orderkey AS idx, CAST({_CASE_LABEL} AS INTEGER) AS label,
               CASE WHEN o_custkey % 37 = 0 THEN 'Unknown' ELSE n_name END AS country,
               CASE WHEN o_custkey % 37 = 0 THEN 'Unknown' ELSE r_name END AS continent,
               CASE WHEN o_custkey % 41 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year,
               o_custkey AS cluster_id
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "meta": (("meta0",), """
        SELECT *, 'DENV' || (label + 1) AS class,
          'v' || lpad(CAST(idx AS VARCHAR), 8, '0')
          || CASE WHEN idx % 7 = 0 THEN ' hDenV' || (label + 1) WHEN idx % 11 = 0 THEN ' denv' || (idx % 4 + 1) ELSE '' END
          || CASE WHEN year IS NULL THEN '' WHEN idx % 3 = 0 THEN '|META_YEAR={' || year || '}' ELSE '|META_YEAR=' || year END
          || CASE WHEN idx % 3 = 0 THEN '|META_COUNTRY={' || shown || '}'
                  WHEN idx % 3 = 1 THEN '|META_COUNTRY=' || shown || ' META_SOURCE=b'
                  ELSE '|META_COUNTRY=' || shown || ';x' END AS header
        FROM (SELECT *, CASE WHEN country = 'Unknown'
                THEN (['unknown','NaN','un','Not Found','NONE',' '])[idx % 6 + 1] ELSE country END AS shown FROM meta0)"""),
    "pred": (("meta",), """
        SELECT protocol, 'm' || m AS model, m AS model_no, idx AS "index",
          CASE p WHEN 0 THEN 'fold_' || (cluster_id % 5 + 1) WHEN 1 THEN continent
                 ELSE coalesce(CAST(year - year % 2 AS VARCHAR), 'Unknown') END AS fold,
          label AS y_true,
          CAST(CASE WHEN (idx * 31 + m * 17 + (p - 1) * 7 + 7) % 100 < 3 + 2 * m THEN (label + 1) % 4 ELSE label END AS INTEGER) AS y_pred,
          cluster_id, class || '::cluster_' || cluster_id AS cluster_key
        FROM meta, (VALUES (0, 'cluster'), (1, 'geographical'), (2, 'temporal')) q(p, protocol),
             (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS m)"""),
    "cscore": (("pred",), """
        SELECT protocol, model, "index", c AS class_index, CAST(y_true = c AS INTEGER) AS positive,
          (("index" * 13 + c * 29 + model_no * 7) % 1000) / 1000.0::DOUBLE + CAST(c = y_pred AS INTEGER) AS score
        FROM pred, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS c)"""),
    "seq0": ((), r"""
        SELECT doc_id AS i, lang, regexp_replace(text, '[^\x00-\x7F]', 'N', 'g') AS raw FROM documents"""),
    "seq": (("seq0",), r"""
        SELECT i AS pos, 'd' || i AS record_id, lang || '.fasta' AS file,
          'DENV' || list_position(['en','fr','de','es'], lang) AS class,
          CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END AS source,
          CASE WHEN i % 2 = 0
            THEN 'virus/' || (['Brazil','Sri_Lanka','un','Viet_Nam','','USA','New_Caledonia'])[i % 7 + 1] || '/d' || i
              || CASE WHEN i % 5 = 0 THEN '|x12345' ELSE '/1987-' || (1990 + i % 30) END || '|ref rest'
            ELSE 'd' || i || ' ' || (['french_guiana isolate','no place','from Cote d''Ivoire','INDIA strain','peru/usa','nigeria'])[i % 6 + 1]
              || CASE WHEN i % 9 = 1 THEN ' n120055' ELSE ' coll ' || (1995 + i % 25) || ' dep 2021' END END AS header,
          raw, regexp_replace(upper(raw), '\s+', '', 'g') AS sequence
        FROM seq0"""),
    "regions": ((), f'SELECT * FROM (VALUES {_REGION_VALUES}) t(region, region_order, "start", "end")'),
    "prof": ((), """
        SELECT vec_id AS sample, CAST(label % 4 AS INTEGER) AS class, CAST(vec_id % 5 AS INTEGER) AS fold,
          CAST(embedding AS DOUBLE[]) AS scores FROM embeddings"""),
    "plong": (("prof",), """
        SELECT sample, class, fold, pos, score, pos < 64 - sample % 8 AS valid FROM (
          SELECT sample, class, fold, unnest(scores) AS score, unnest(range(0, len(scores))) AS pos FROM prof)"""),
    "splong": (("plong",), """
        SELECT strategy, plong.* FROM plong, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS strategy)
        WHERE sample % 3 <> strategy - 1"""),
    "site": (("plong", "regions"), """
        SELECT region, region_order, 'DENV' || (class + 1) AS class, sample AS seq_id, pos - "start" + 1 AS site_pos,
          CASE WHEN (sample + pos) % 53 = 0 THEN 'N' WHEN abs(score) < 0.01 THEN '-' WHEN score < -0.1 THEN 'A'
               WHEN score < 0 THEN 'C' WHEN score < 0.1 THEN 'G' ELSE 'T' END AS symbol
        FROM plong JOIN regions ON pos >= "start" AND pos < "end" """),
    "aligned": (("site",), """
        SELECT region, region_order, class, seq_id, string_agg(symbol, '' ORDER BY site_pos) AS aligned
        FROM site GROUP BY ALL"""),
    "foldm": ((), """
        SELECT l_returnflag || l_linestatus AS model, CAST(year(l_shipdate) AS INTEGER) AS fold,
          round(avg(l_discount) * 10, 9) AS accuracy, round(avg(l_tax) * 10, 9) AS balanced_accuracy,
          round(avg(l_quantity) / 50, 9) AS macro_f1 FROM lineitem GROUP BY ALL"""),
}


def with_views(names: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the named views and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        order.append(name)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    head = "WITH RECURSIVE " if body.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    rest = body.lstrip()
    if rest.upper().startswith("WITH RECURSIVE"):
        return f"{head}{ctes},\n{rest[len('WITH RECURSIVE'):]}"
    if rest.upper().startswith("WITH "):
        return f"{head}{ctes},\n{rest[len('WITH '):]}"
    return f"{head}{ctes}\n{rest}"
