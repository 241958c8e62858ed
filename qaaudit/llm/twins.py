"""DuckDB SQL for the rows of operators that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_SOUND = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
_DISTANCE = "CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
#: floor(total / n) of whole numbers
_MEAN = "CAST((total - (total % n + n) % n) // n AS BIGINT)"


def simplex_clusters(k: int = 40, rounds: int = 5) -> str:
    """Every vector is compared with every centroid."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS v FROM embeddings WHERE {_SOUND})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := {_DISTANCE}, c := b.c)) AS best FROM kept a, c{i} b GROUP BY r)"
        )
        if i < rounds:
            steps.append(f"""
                c{i + 1} AS MATERIALIZED (
                    SELECT c, CASE WHEN m.v IS NULL THEN old.v ELSE m.v END AS v FROM c{i} old LEFT JOIN (
                        SELECT c, list({_MEAN} ORDER BY i) AS v FROM (
                            SELECT best.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS total, count(*) AS n
                            FROM a{i} JOIN kept USING (r), range(1, 65) AS places(i) GROUP BY ALL
                        ) GROUP BY c
                    ) m USING (c)
                )""")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
               CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = best.c
    """


def part_codes(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """Every part of every vector is compared with every entry of its codebook."""
    cut = f"v[p * {width} + 1 : p * {width} + {width}]"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {_WHOLE} AS v FROM embeddings WHERE {_SOUND})",
        f"cut AS MATERIALIZED (SELECT r, p, {cut} AS v FROM kept, range({parts}) AS positions(p))",
        f"first AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e, v FROM kept QUALIFY e < {entries})",
        f"b0 AS MATERIALIZED (SELECT p, e, {cut} AS v FROM first, range({parts}) AS positions(p))",
    ]
    for i in range(rounds + 1):
        steps.append(f"""
            a{i} AS MATERIALIZED (
                SELECT a.r, a.p, min(struct_pack(d := {_DISTANCE}, e := b.e)) AS best FROM cut a JOIN b{i} b ON a.p = b.p GROUP BY ALL
            )""")
        if i < rounds:
            steps.append(f"""
                b{i + 1} AS MATERIALIZED (
                    SELECT p, e, CASE WHEN m.v IS NULL THEN old.v ELSE m.v END AS v FROM b{i} old LEFT JOIN (
                        SELECT p, e, list({_MEAN} ORDER BY i) AS v FROM (
                            SELECT a.p, best.e AS e, i, CAST(sum(cut.v[i]) AS BIGINT) AS total, count(*) AS n
                            FROM a{i} a JOIN cut ON cut.r = a.r AND cut.p = a.p, range(1, {width + 1}) AS places(i) GROUP BY ALL
                        ) GROUP BY p, e
                    ) m USING (p, e)
                )""")
    return f"""
        WITH {", ".join(steps)},
        coded AS (
            SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
        ),
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (r), books
    """


#: The rate is a closed form here: sources in the order in which they reach their limit, the first that stays below it decides.
SOURCE_MIXING = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               CAST('0x' || substr(sha256(concat_ws('/', 'mix', doc_id, sha256(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
                   + 1 / 9007199254740992.0::DOUBLE AS u,
               (length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g')) + 1)::DOUBLE / (length(coalesce(text, '')) + 1)::DOUBLE AS weight
        FROM documents
    ),
    sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
        FROM docs GROUP BY source
    ),
    steps AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0))::DOUBLE
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS rate,
               row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS step
        FROM sources
        WINDOW earlier AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    rate AS (SELECT arg_min(rate, step) AS rate FROM steps WHERE weight * rate <= 3 * source_size),
    targets AS (SELECT source, source_size, least(sources.weight * rate, 3.0::DOUBLE * source_size) AS target FROM sources, rate),
    plan AS (
        SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
               least(target - epochs * source_size::DOUBLE, source_size::DOUBLE) AS budget
        FROM targets
    ),
    placed AS (
        SELECT docs.*, source_size, target, epochs, budget,
               sum(size) OVER (PARTITION BY docs.source ORDER BY -ln(u) / weight, r ROWS UNBOUNDED PRECEDING) - size AS before
        FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source
    )
    SELECT doc_id, size, source_size, target,
           CAST(size * (epochs + CASE WHEN before < budget AND (before + size <= budget OR size <= 2 * (budget - before)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM placed
"""
