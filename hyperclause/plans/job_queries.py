"""The runnable jobs as queries: each runs twice over the whole tables into a new folder, and what is there then is the result."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

import jobs
from jobs import alert_screen, labelled_sets

from ..functions.hashing import mix_sql
from .registry import query
from .search_queries import shared_folder

_SETS, _SCREEN = (json.loads((Path(jobs.__file__).parent / f"{n}.json").read_text()) for n in ("labelled_sets", "alert_screen"))
_BLANKS = "[\\x20\\x09-\\x0D]+"


def _twice(spark, sf_dir, job, config, name):
    """Runs the job, then runs it again into the same folder."""
    output = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, **config | {"documents": f"{sf_dir}/documents.parquet", "labels": f"{sf_dir}/labels.parquet", "output": output})
    return job.read(spark, output)


_tie = mix_sql("ascii(grp) * 256 + ascii(right(grp, 1))", "length(grp)", _SETS["seed"])


@query(
    "job1_labelled_sets",
    f"""WITH RECURSIVE y AS (SELECT doc_id, max({_SETS["task"]}) AS y FROM labels WHERE {_SETS["task"]} IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
    d AS (SELECT *, trim(regexp_replace(translate(text, '{labelled_sets.UPPER}', '{labelled_sets.LOWER}'), '{_BLANKS}', ' ', 'g')) AS plain FROM documents),
    e AS (SELECT doc_id, text, lang, source, y, sha256(plain) AS grp FROM d JOIN y USING (doc_id) WHERE plain <> ''),
    g AS (SELECT grp, count(*) AS copies, min(doc_id) AS least, CASE WHEN min(y) = max(y) THEN min(y) END AS label FROM e GROUP BY grp),
    o AS (SELECT grp, copies AS n, row_number() OVER (ORDER BY copies DESC, {_tie}, grp) AS r,
                 CAST(floor(sum(copies) OVER () * {_SETS["train"]}) AS BIGINT) AS a, CAST(floor(sum(copies) OVER () * {_SETS["valid"]}) AS BIGINT) AS b FROM g WHERE label IS NOT NULL),
    fill AS (
        SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS z, '' AS grp, '' AS split
        UNION ALL
        SELECT o.r, CASE WHEN x + n <= a THEN x + n ELSE x END, CASE WHEN x + n > a AND z + n <= b THEN z + n ELSE z END, o.grp,
               CASE WHEN x + n <= a THEN 'train' WHEN z + n <= b THEN 'valid' ELSE 'test' END
        FROM fill JOIN o ON o.r = fill.r + 1),
    w AS (SELECT label, 1.0 / sum(copies) AS weight FROM g JOIN fill USING (grp) WHERE split = 'train' GROUP BY label)
    SELECT e.doc_id, e.text, e.lang, e.source, g.copies, e.doc_id = g.least AS first, CASE WHEN split = 'train' THEN CAST(w.weight AS DOUBLE) END AS weight,
           coalesce(split, 'conflict') AS split, e.y
    FROM e JOIN g USING (grp) LEFT JOIN fill ON fill.grp = e.grp AND fill.r > 0 LEFT JOIN w ON w.label = g.label""",
)
def job1(spark, sf_dir):
    return _twice(spark, sf_dir, labelled_sets, _SETS, "labelled-sets")


_FOUND = " UNION ALL ".join(f"SELECT doc_id, source, '{r['name']}' AS alert, '{r['tier']}' AS tier FROM documents WHERE regexp_matches(text, '{r['pattern']}')" for r in _SCREEN["rules"])


@query(
    "job2_alert_screen",
    f"""WITH h AS ({_FOUND}),
    s AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
    l AS (SELECT DISTINCT doc_id, 'quality=' || quality AS part FROM labels WHERE quality IS NOT NULL UNION SELECT DISTINCT doc_id, 'toxic=' || toxic FROM labels WHERE toxic IS NOT NULL),
    support AS (SELECT alert, count(DISTINCT doc_id) AS total FROM h GROUP BY alert),
    r AS (
        SELECT alert, tier, coalesce(h.source, 'null') AS part, count(DISTINCT doc_id) AS documents, any_value(total) AS total, 'source' AS kind
        FROM h JOIN s ON s.source IS NOT DISTINCT FROM h.source WHERE doc_id IS NOT NULL GROUP BY alert, tier, h.source
        UNION ALL
        SELECT alert, tier, part, count(DISTINCT doc_id), any_value(total), 'label' FROM h JOIN l USING (doc_id) JOIN support USING (alert) GROUP BY alert, tier, part)
    SELECT doc_id, alert, tier, source AS part, CAST(NULL AS BIGINT) AS documents, CAST(NULL AS BIGINT) AS total, CAST(NULL AS DOUBLE) AS share, 'hit' AS kind FROM h
    UNION ALL
    SELECT NULL, alert, tier, part, documents, CAST(total AS BIGINT), round(documents / total, 9), kind FROM r""",
)
def job2(spark, sf_dir):
    return _twice(spark, sf_dir, alert_screen, _SCREEN, "alert-screen")
