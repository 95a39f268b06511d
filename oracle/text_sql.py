"""SQL answers for text and vector jobs. RE2 has no look-around, so the patterns
here consume a neighbour and put it back where the Spark ones only look at it."""

import re

from driftwise.functions.text import INJECTION_PATTERNS, ISSUE_TERMS, NOT_IN_COMPLAINTS, RELATED_ISSUES
from driftwise.plans.cause_jobs import SALES_SCOPE
from driftwise.plans.text_jobs import EXPECTED, STOP_WORDS
from oracle.cause_sql import longest
from oracle.views import listing

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
W = r"\p{L}\p{M}\p{N}_"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def flags(text: str) -> str:
    arms = ", ".join(f"CASE WHEN regexp_matches(lower({text}), {quoted(p)}) THEN '{label}' END"
                     for p, label, _ in INJECTION_PATTERNS)
    # list_distinct does not keep order, so repeats are dropped by position.
    return (f"array_to_string(list_filter(list_filter([{arms}], lambda x: x IS NOT NULL),"
            f" lambda x, i: list_position(list_filter([{arms}], lambda y: y IS NOT NULL), x) = i), ',')")


# Each pattern with the text put back around it, and what replaces it.
MASKS = (
    ("email", rf"[{W}.+-]+@[{W}-]+\.[{W}.]+", "[email]"),
    ("upi", rf"(^|[^{W}])([{W}.-]*[{W}][{W}.-]*@[a-zA-Z][a-zA-Z0-9]+)([^.@{W}-]|$)", r"\1[upi]\3"),
    ("pan", rf"(^|[^{W}])([A-Z]{{5}}[0-9]{{4}}[A-Z])($|[^{W}])", r"\1[pan]\3"),
    ("card", rf"(^|[^{W}])((?:\d[ -]?){{15,18}}\d)($|[^{W}])", r"\1[card]\3"),
    ("card", rf"(^|[^{W}])(\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{4}})($|[^{W}])", r"\1[card]\3"),
    ("phone", rf"(^|[^{W}])((?:91[ -]?)?[6-9]\d{{4}}[ -]?\d{{5}})($|[^{W}])", r"\1[phone]\3"),
    ("id-number", rf"(^|[^{W}])(\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}})($|[^{W}])", r"\1[id-number]\3"),
)


# A neighbour shared by two matches is consumed by the first, so go over twice.
PASSES = 2


def masked(text: str) -> str:
    for _, pattern, put in MASKS:
        for _ in range(PASSES):
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(put)}, 'g')"
    return text


def mask_counts(text: str) -> str:
    told = []
    for name, pattern, put in MASKS:
        counts = []
        for _ in range(PASSES):
            counts.append(f"len(regexp_extract_all({text}, {quoted(pattern)}))")
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(put)}, 'g')"
        n = "(" + " + ".join(counts) + ")"
        told.append(f"CASE WHEN {n} > 0 THEN 'pii:{name} x' || {n} END")
    return f"array_to_string(list_filter([{', '.join(told)}], lambda x: x IS NOT NULL), ',')"


def issue_case(text: str, give) -> str:
    arms = " ".join(f"WHEN contains(lower({text}), {quoted(t)}) THEN {give(i, t)}"
                    for i, terms in ISSUE_TERMS for t in terms)
    return f"CASE {arms} "


ISSUE = issue_case("text", lambda i, t: f"'{i}'") + "ELSE 'other' END"
AT = issue_case("text", lambda i, t: f"strpos(lower(text), {quoted(t)})") + "ELSE 1 END"
SUBJECT = issue_case("description", lambda i, t: f"'{i}'") + "ELSE 'other' END"
EXPECT = "CASE " + " ".join(
    f"WHEN subject = '{s}' THEN {listing(r)}" for s, r in RELATED_ISSUES.items() if r
) + f" ELSE {listing(i for i, _ in ISSUE_TERMS)} END"

COMPANY = "|".join(re.escape(t).replace("\\ ", " ") for t in NOT_IN_COMPLAINTS)


def complaint(text: str) -> str:
    body = (f"(CASE WHEN strpos(substr({text}, 1, 40), ':') > 0"
            f" THEN substr({text}, strpos({text}, ':') + 1) ELSE {text} END)")
    return f"""coalesce(nullif(array_to_string(list_transform(list_filter(
        string_split_regex(trim(lower({body})), '\\s+'),
        lambda w: length(w) > 3 AND NOT regexp_matches(w, '{COMPANY}')
                  AND NOT regexp_matches(w, '[\\d_]|-\\w+-')), lambda w: trim(w, '.,;')), ' '), ''), {body})"""


def tokens(view: str, keys: str, text: str) -> str:
    return f"""SELECT {keys}, token, count(*) AS tf FROM (
        SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[{W}]{{2,}}')) AS token FROM {view})
        WHERE token NOT IN ({STOPS}) GROUP BY ALL"""


def ranked(queries: str, docs: str, k: int) -> str:
    """Cosine ranking as SQL over views queries(query_id, query, lo, hi) and docs."""
    return f"""
        WITH dt AS ({tokens(docs, 'doc_id, ts', 'text')}),
        idf AS (SELECT token, ln((1.0 + (SELECT count(*) FROM {docs})) / (1.0 + count(*))) + 1.0 AS idf
                FROM dt GROUP BY token),
        dw AS (SELECT doc_id, ts, token, (1.0 + ln(tf)) * idf AS w FROM dt JOIN idf USING (token)),
        qt AS ({tokens(queries, 'query_id, lo, hi', 'query')}),
        qw AS (SELECT query_id, lo, hi, token, (1.0 + ln(tf)) * idf AS w FROM qt JOIN idf USING (token)),
        dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc_id),
        qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id),
        scored AS (
          SELECT query_id, doc_id, sum(dw.w * qw.w) / (any_value(dn.n) * any_value(qn.n)) AS score
          FROM dw JOIN qw ON dw.token = qw.token AND dw.ts BETWEEN qw.lo AND qw.hi
          JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id)
        SELECT query_id, rank, doc_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
          FROM scored WHERE score >= 0.15) WHERE rank <= {k}"""


VIEWS = {
    "v_pieces": """
        SELECT doc_id, pos - 1 AS pos, piece,
               coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos
              FROM (SELECT doc_id, list_filter(string_split(
                      regexp_replace(text, '([.!?]\\s+)', '\\1' || chr(57344), 'g'), chr(57344)),
                      lambda p: p <> '') AS ps FROM v_documents))""",
    "v_sentence": """
        SELECT doc_id, pos, start,
               CASE WHEN regexp_matches(piece, '[.!?]\\s+$') THEN rtrim(piece, chr(32) || chr(9) || chr(10)
                    || chr(11) || chr(12) || chr(13)) ELSE piece END AS quote
        FROM v_pieces""",
    "v_passages": """
        SELECT item_id AS query_id, text AS query,
               TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(item_id * 30 % 1200 AS INTEGER)) AS lo,
               TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(item_id * 30 % 1200 AS INTEGER))
                 + INTERVAL 540 DAY AS hi
        FROM benchmark""",
    "v_desk_weights": f"""
        WITH counted AS (SELECT region || '/' || doc_type AS desk, token, sum(tf) AS tf
                         FROM ({tokens('v_documents', 'region, doc_type', 'text')}) GROUP BY ALL),
        idf AS (SELECT token, ln((1.0 + (SELECT count(DISTINCT desk) FROM counted)) / (1.0 + count(*))) + 1.0 AS idf FROM counted GROUP BY token),
        w AS (SELECT desk, token, (1.0 + ln(tf)) * idf AS w FROM counted JOIN idf USING (token))
        SELECT desk, token, w / sqrt(sum(w * w) OVER (PARTITION BY desk)) AS w FROM w""",
    "v_desks": "SELECT desk, row_number() OVER (ORDER BY desk) - 1 AS i FROM (SELECT DISTINCT desk FROM v_desk_weights)",
    # Eigenvalues and vectors of the desks' Gram matrix: plane rotations over all pairs of lines, again and again.
    "v_turning": """
        SELECT 0 AS step, (SELECT count(*) FROM v_desks)::INT AS n,
               (SELECT list(g ORDER BY i, j) FROM (SELECT a.i AS i, b.i AS j, sum(x.w * y.w) AS g
                  FROM v_desk_weights x JOIN v_desks a ON a.desk = x.desk JOIN v_desk_weights y ON y.token = x.token
                  JOIN v_desks b ON b.desk = y.desk GROUP BY a.i, b.i)) AS m,
               (SELECT list(CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY a.i, b.i) FROM v_desks a, v_desks b) AS v,
               (SELECT list(a.i::INT ORDER BY a.i, b.i) FROM v_desks a JOIN v_desks b ON a.i < b.i) AS ps,
               (SELECT list(b.i::INT ORDER BY a.i, b.i) FROM v_desks a JOIN v_desks b ON a.i < b.i) AS qs
        UNION ALL
        SELECT step + 1, n,
               list_transform(range(n * n), lambda x: CASE WHEN x // n = p THEN c * t[x + 1] - s * t[q * n + x % n + 1]
                 WHEN x // n = q THEN s * t[p * n + x % n + 1] + c * t[x + 1] ELSE t[x + 1] END),
               list_transform(range(n * n), lambda x: CASE WHEN x % n = p THEN c * v[x + 1] - s * v[(x // n) * n + q + 1]
                 WHEN x % n = q THEN s * v[(x // n) * n + p + 1] + c * v[x + 1] ELSE v[x + 1] END), ps, qs
        FROM (SELECT *, list_transform(range(n * n), lambda x: CASE WHEN x % n = p THEN c * m[x + 1] - s * m[(x // n) * n + q + 1]
                 WHEN x % n = q THEN s * m[(x // n) * n + p + 1] + c * m[x + 1] ELSE m[x + 1] END) AS t
        FROM (SELECT *, tan / sqrt(1 + tan * tan) AS s, 1 / sqrt(1 + tan * tan) AS c
        FROM (SELECT *, CASE WHEN abs(m[p * n + q + 1]) < 1e-300 THEN 0.0::DOUBLE ELSE
                 (CASE WHEN m[q * n + q + 1] >= m[p * n + p + 1] THEN 1 ELSE -1 END)
                 / (abs((m[q * n + q + 1] - m[p * n + p + 1]) / (2 * m[p * n + q + 1]))
                    + sqrt(1 + pow((m[q * n + q + 1] - m[p * n + p + 1]) / (2 * m[p * n + q + 1]), 2)))
                 * sign(m[p * n + q + 1]) END AS tan
        FROM (SELECT *, ps[step % len(ps) + 1] AS p, qs[step % len(ps) + 1] AS q FROM v_turning WHERE step < 10 * len(ps)))))""",
    "v_directions": """
        SELECT k, m[(k * n + k + 1)::INT] AS square, list_transform(range(n), lambda i: v[(i * n + k + 1)::INT]) AS way,
               row_number() OVER (ORDER BY m[(k * n + k + 1)::INT] DESC) AS place
        FROM (SELECT * FROM v_turning ORDER BY step DESC LIMIT 1), LATERAL (SELECT unnest(range(n)) AS k)""",
    "v_desk_places": """
        SELECT desk, place, sqrt(square) * way[(i + 1)::INT] AS x FROM v_desks, v_directions WHERE place <= 8""",
    "v_passage_hits": ranked("v_passages", "v_documents", 5),
    "v_doc_idf": f"""
        SELECT token, ln((1.0 + (SELECT count(*) FROM v_documents)) / (1.0 + count(*))) + 1.0 AS idf
        FROM ({tokens('v_documents', 'doc_id', 'text')}) GROUP BY token""",
    "v_tickets": "SELECT doc_id, ts, region, text FROM v_notes WHERE doc_type = 'support_ticket'",
    "v_readings": f"""
        SELECT *, CASE WHEN cut > 0 THEN spot - 1 + cut ELSE length(text) END AS finish
        FROM (SELECT *, length(regexp_extract(substr(text, 1, spot - 1), '(?s)^(.*[.!?]\\s+)', 1)) AS start,
                     length(regexp_extract(substr(text, spot), '(?s)^(.*?[.!?])\\s', 1)) AS cut
              FROM (SELECT *, {ISSUE} AS issue, {AT} AS spot FROM v_notes))""",
    "v_asked": f"""
        SELECT *, {EXPECT} AS expected FROM (
          SELECT finding_id || '|' || doc_id AS query_id, finding_id, doc_id,
                 {complaint('description')} AS query, {SUBJECT} AS subject,
                 CAST(start_day AS TIMESTAMP) AS lo,
                 CAST(end_day AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS hi
          FROM v_verdicts WHERE state = 'verified')""",
    "v_ticket_hits": ranked("v_asked", "v_tickets", 12),
    "v_support": f"""
        SELECT finding_id, doc_id, coalesce(searched, 0) AS searched, coalesce(supporting, 0) AS supporting,
               coalesce(unrelated, 0) AS unrelated, coalesce(flagged, 0) AS flagged
        FROM v_asked LEFT JOIN (
          SELECT h.query_id, count(*) AS searched,
                 count(*) FILTER (list_contains(a.expected, r.issue)) AS supporting,
                 count(*) FILTER (NOT list_contains(a.expected, r.issue)) AS unrelated,
                 count(*) FILTER ({flags('r.text')} <> '') AS flagged
          FROM v_ticket_hits h JOIN v_asked a USING (query_id) JOIN v_readings r ON r.doc_id = h.doc_id
          GROUP BY h.query_id) USING (query_id)""",
    "v_turns": "SELECT conv_id, turn, role || ': ' || text AS text FROM conversations",
}

SAFE = (f"regexp_replace(replace(replace({masked('text')}, '<<<DOCUMENT>>>', '[fence]'),"
        f" '<<<END DOCUMENT>>>', '[fence]'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')")
LABELS = [",".join(EXPECTED.get(i, ())) for i in range(16)]

ANSWERS = {
    "sentences": """SELECT doc_id, count(*) AS sentences, CAST(max(start + length(quote)) AS BIGINT) AS last_end,
        CAST(sum(start * (pos + 1)) AS BIGINT) AS start_sum,
        CAST(sum((start + length(quote)) * (pos + 1)) AS BIGINT) AS end_sum
        FROM v_sentence GROUP BY doc_id""",
    "tfidf_topk": "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM v_passage_hits",
    "best_sentence": f"""WITH said AS ({tokens("(SELECT * FROM v_sentence WHERE doc_id IN"
                                              " (SELECT doc_id FROM v_passage_hits))",
                                              'doc_id, start, quote', 'quote')}),
        sw AS (SELECT doc_id, start, quote, token, (1.0 + ln(tf)) * idf AS w FROM said JOIN v_doc_idf USING (token)),
        sn AS (SELECT doc_id, start, sqrt(sum(w * w)) AS n FROM sw GROUP BY ALL),
        qt AS ({tokens('v_passages', 'query_id', 'query')}),
        qw AS (SELECT query_id, token, (1.0 + ln(tf)) * idf AS w FROM qt JOIN v_doc_idf USING (token)),
        hits AS (SELECT h.query_id, h.doc_id, sw.start, any_value(quote) AS quote,
                        round(sum(sw.w * qw.w) / any_value(sn.n), 9) AS score
                 FROM v_passage_hits h JOIN sw ON sw.doc_id = h.doc_id
                 JOIN qw ON qw.query_id = h.query_id AND qw.token = sw.token
                 JOIN sn ON sn.doc_id = sw.doc_id AND sn.start = sw.start
                 GROUP BY h.query_id, h.doc_id, sw.start)
        SELECT query_id, doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(quote) AS BIGINT) AS "end",
               sha256(quote) AS quote
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, start) AS rn
              FROM hits) WHERE rn = 1""",
    "latent_values": """SELECT CAST(place AS INTEGER) AS direction, round(sqrt(square), 6) AS strength FROM v_directions WHERE place <= 8""",
    "latent_neighbours": """SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank
        FROM (SELECT a.desk AS query_id, b.desk AS vec_id, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS score
              FROM v_desk_places a JOIN v_desk_places b USING (place) GROUP BY a.desk, b.desk)) WHERE rank <= 4""",
    "vector_topk": """WITH flat AS (
          SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
          FROM embeddings),
        mid AS (SELECT label, pos, avg(x) AS x FROM flat GROUP BY ALL),
        norm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM flat GROUP BY vec_id),
        mnorm AS (SELECT label, sqrt(sum(x * x)) AS n FROM mid GROUP BY label),
        scored AS (SELECT m.label AS query_id, f.vec_id, sum(f.x * m.x) / any_value(n.n * mn.n) AS score
                   FROM flat f JOIN mid m USING (pos) JOIN norm n ON n.vec_id = f.vec_id
                   JOIN mnorm mn ON mn.label = m.label GROUP BY m.label, f.vec_id)
        SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank
          FROM scored WHERE score >= 0) WHERE rank <= 10""",
    "complaint_query": f"SELECT doc_id, {complaint('text')} AS query FROM v_notes",
    "rule_extract": f"""SELECT doc_id, issue, start, finish AS "end", substr(text, start + 1, finish - start) AS quote,
        CASE WHEN issue = 'other' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
        {', '.join(f"{longest('text', t)} AS {d}" for d, t in SALES_SCOPE.items())} FROM v_readings""",
    "issue_counts": """SELECT issue, count(*) AS tickets FROM v_readings WHERE doc_type = 'support_ticket'
        GROUP BY issue""",
    "support_counts": "SELECT * FROM v_support",
    "injection_flags": f"SELECT conv_id, turn, {flags('text')} AS flags FROM v_turns",
    "redact": f"""SELECT doc_id, sha256({masked('text')}) AS text, {mask_counts('text')} AS masked
        FROM v_documents""",
    "quarantine": f"""SELECT doc_id, flags, length(safe) AS length, sha256(safe) AS text
        FROM (SELECT doc_id, {flags('text')} AS flags, {SAFE} AS safe FROM v_documents)""",
    "citation_spans": """SELECT item_id, doc_id, strpos(d.text, b.text) - 1 AS start,
        strpos(d.text, b.text) - 1 + length(b.text) AS "end"
        FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
    "extract_score": f"""SELECT "set", count(*) AS n, count(*) FILTER (good) AS "right",
        round(100.0 * count(*) FILTER (good) / count(*), 1) AS pct
        FROM (SELECT doc_type AS "set", CASE WHEN label = '' THEN issue IN ('other', 'quality')
                ELSE list_contains(string_split(label, ','), issue) END AS good
              FROM (SELECT doc_type, issue,
                      ({listing(LABELS)})[CAST(substr(doc_id, 6) AS BIGINT) % 16 + 1] AS label
                    FROM v_readings)) GROUP BY "set" """,
    "doc_view": f"""SELECT doc_id, doc_type, region, length({masked('text')}) AS length,
        {flags('text')} AS flags, sha256({masked('text')}) AS text FROM v_documents
        WHERE region IN ('ASIA', 'EUROPE', 'All')""",
}
