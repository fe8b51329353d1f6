"""DuckDB SQL for the queries of veilspark.queries, over the same tables."""

from __future__ import annotations

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}\b"
CARD = "(?:^|[^0-9-])([0-9](?:[ -]?[0-9]){12,18})(?:[^0-9-]|$)"


def _norm(text: str) -> str:
    joined = rf"regexp_replace(regexp_replace({text}, '(\p{{L}})-\s*\n\s*(\p{{L}})', '\1\2', 'g'), '-\s*\n\s*(\S)', '-\1', 'g')"
    return rf"trim(regexp_replace({joined}, '\s+', ' ', 'g'))"


#: Normalised documents, as n.
DOCS = f"n AS (SELECT doc_id, {_norm('text')} AS n FROM documents)"


def _places(pattern: str, keep: str = "true", source: str = "n", name: str = "p") -> str:
    """A CTE (doc_id, start, stop, matched_text) of all matches of a pattern without look-around."""
    return f"""{name} AS (
      SELECT doc_id, (coalesce(list_sum([length(x) FOR x IN gap[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN hit[1:i-1]]), 0))::INT AS start, hit[i] AS matched_text
      FROM (SELECT doc_id, hit, gap, unnest(range(1, len(hit) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(n, '{pattern}') AS hit, regexp_split_to_array(n, '{pattern}') AS gap FROM {source}))
      WHERE {keep.replace('MATCH', 'hit[i]')})"""


IP = f"WITH {DOCS}, " + _places("[0-9.]+", rf"regexp_full_match(MATCH, '({OCTET}\.){{3}}{OCTET}')", name="ip")
EMAILS = f"WITH {DOCS}, " + _places(EMAIL, name="email")
BOTH = IP + ", " + _places(EMAIL, name="email") + ", hits AS (SELECT doc_id, start, matched_text, 'ipAddresses' AS category FROM ip UNION ALL SELECT doc_id, start, matched_text, 'emailAddresses' FROM email)"
LUHN = """list_sum([CASE WHEN (len(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END FOR i IN range(1, len(d) + 1)]) % 10 = 0"""
CARDS = f"cards AS (SELECT doc_id, m AS matched_text FROM (SELECT doc_id, m, string_split(regexp_replace(m, '[^0-9]', '', 'g'), '') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(replace(n, ' ', '  '), '{CARD}', 1)) AS m FROM n)) WHERE {LUHN})"
PHONES = (
    _places(r"(?:\+?1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}", name="pa")
    + ", "
    + _places(r"\+[0-9][0-9 .()-]{6,20}[0-9]", "length(regexp_replace(MATCH, '[^0-9]', '', 'g')) BETWEEN 8 AND 15", name="pc")
    + ", phones AS (SELECT doc_id, start, arg_max(matched_text, length(matched_text)) AS matched_text FROM (SELECT * FROM pa UNION ALL SELECT * FROM pc) GROUP BY doc_id, start)"
)
EVERY = IP + ", " + _places(EMAIL, name="email") + f", {CARDS}, {PHONES}"


def _occurrences(literal: str, text: str = "n") -> str:
    return f"((length({text}) - length(replace({text}, '{literal}', ''))) / {len(literal)})"


def _digits(n: int, factor: int = 1) -> str:
    return f"lpad(((o_orderkey * {factor}) % {10**n})::VARCHAR, {n}, '0')"


def _labelled(value: str) -> str:
    return f"SELECT o_orderkey AS doc_id, {value} AS matched_text FROM orders"


def _by(column: str) -> str:
    return f"{IP} SELECT {column}, sum(n)::BIGINT AS n_spans, count(*) AS n_docs FROM (SELECT doc_id, count(*) AS n FROM ip GROUP BY doc_id) JOIN documents USING (doc_id) GROUP BY {column}"


THE = f"WITH {DOCS}, c AS (SELECT doc_id, {_occurrences('the', 'lower(n)')}::BIGINT AS n FROM n)"
PLAN = IP + ", v AS (SELECT doc_id, matched_text, min(start) AS start FROM ip GROUP BY ALL)"

ORACLES: dict[str, str] = {
    "email_spans": f"{EMAILS} SELECT doc_id, start, start + length(matched_text) AS stop, matched_text FROM email",
    "ip_spans": f"{IP} SELECT doc_id, start, start + length(matched_text) AS stop, matched_text FROM ip",
    "phone_spans": f"WITH {DOCS}, {PHONES} SELECT doc_id, start, start + length(matched_text) AS stop, matched_text FROM phones",
    "card_spans": f"WITH {DOCS}, {CARDS} SELECT doc_id, matched_text, count(*) AS n_spans FROM cards GROUP BY ALL",
    "ssn_spans": _labelled(f"'123-45-' || {_digits(4)}"),
    "ein_spans": _labelled(f"'12-' || {_digits(7)}"),
    "account_spans": _labelled(_digits(10, 7919)),
    "passport_spans": _labelled(f"'X' || {_digits(7)}"),
    "licence_spans": _labelled(f"'D' || {_digits(7)}"),
    "birth_date_spans": _labelled("'1990-01-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0')"),
    "health_spans": _labelled(f"'CL-' || {_digits(6)}"),
    "employee_spans": _labelled(f"'E-' || {_digits(5)}"),
    "address_spans": _labelled("(o_orderkey % 999 + 1)::VARCHAR || ' Main Street, Springfield, IL ' || (o_orderkey % 80000 + 10000)::VARCHAR"),
    "spans_by_lang": _by("lang"),
    "spans_by_source": _by("source"),
    "normalize_text": f"WITH {DOCS} SELECT doc_id, length(n)::BIGINT AS n_normalized, md5(n) AS digest FROM n",
    "secret_tokens": f"WITH {DOCS} SELECT DISTINCT doc_id, m AS matched_text FROM (SELECT doc_id, unnest(regexp_extract_all(n, '(?:^|[^A-Za-z0-9])([0-9a-f]{{40}})(?:[^A-Za-z0-9]|$)', 1)) AS m FROM n)",
    "exact_rule_spans": f"WITH {DOCS} SELECT doc_id, rule_line, n_spans FROM (SELECT doc_id, 1 AS rule_line, {_occurrences('license', 'lower(n)')}::BIGINT AS n_spans FROM n UNION ALL SELECT doc_id, 2, {_occurrences('The')}::BIGINT FROM n) WHERE n_spans > 0",
    "rule_counts": f"""{EVERY}, every AS (
        SELECT doc_id, 'email addresses' AS rule_description, 1 AS k FROM email UNION ALL SELECT doc_id, 'ip addresses', 1 FROM ip UNION ALL SELECT doc_id, 'credit card numbers', 1 FROM cards
        UNION ALL SELECT doc_id, 'phone numbers', 1 FROM phones UNION ALL SELECT doc_id, '“license”', {_occurrences('license', 'lower(n)')}::BIGINT FROM n UNION ALL SELECT doc_id, '“The”', {_occurrences('The')}::BIGINT FROM n)
        SELECT rule_description, sum(k)::BIGINT AS n_spans, count(DISTINCT doc_id) AS n_docs FROM every WHERE k > 0 GROUP BY rule_description""",
    "unused_rules": "SELECT '“no such words here”' AS rule_description WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), 'no such words here'))",
    "spans_by_category": f"""{EVERY}, every AS (SELECT doc_id, 'emailAddresses' AS category FROM email UNION ALL SELECT doc_id, 'ipAddresses' FROM ip UNION ALL SELECT doc_id, 'creditCardNumbers' FROM cards UNION ALL SELECT doc_id, 'phoneNumbers' FROM phones)
        SELECT category, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM every GROUP BY category""",
    "docs_without_findings": f"{BOTH} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)",
    "runaway_rules": f"{THE} SELECT doc_id, '“the”' AS rule_description, n FROM c WHERE n > 40",
    "kept_after_refusal": f"{THE} SELECT sum(n)::BIGINT AS n_spans, count(*) AS n_docs FROM c WHERE n BETWEEN 1 AND 40",
    "plan_of_addresses": f"{PLAN} SELECT doc_id::VARCHAR AS source_name, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS pos, matched_text AS value, 'ip addresses' AS label FROM v",
    "plan_merge": f"{PLAN} SELECT doc_id::VARCHAR AS source_name, count(*) + 1 AS n_items, count(*) FILTER (matched_text NOT LIKE '1%') + 1 AS n_ticked FROM v GROUP BY doc_id",
    "masked_findings": f"""{EVERY}, every AS (
        SELECT doc_id, matched_text AS m, 'email addresses' AS rule FROM email UNION ALL SELECT doc_id, matched_text, 'ip addresses' FROM ip UNION ALL SELECT doc_id, matched_text, 'credit card numbers' FROM cards
        UNION ALL SELECT doc_id, matched_text, 'phone numbers' FROM phones UNION ALL SELECT doc_id, unnest(regexp_extract_all(n, '(?i)license')), 'exact rule' FROM n)
        SELECT doc_id, 1 AS page, repeat('•', least(greatest(length(m), 4), 18)::INT) AS value, rule FROM every""",
    "preview_report": f"{EMAILS} SELECT doc_id, start, 'email addresses' AS rule_description, repeat('•', least(length(matched_text), 12)::INT) AS shown FROM email",
    "page_summary": f"{BOTH} SELECT doc_id, count(*) AS n_spans, array_to_string(list_sort(list_distinct(list(CASE category WHEN 'ipAddresses' THEN 'ip addresses' ELSE 'email addresses' END))), ',') AS rules FROM hits GROUP BY doc_id",
    "redaction_documents": f"{BOTH} SELECT d.doc_id, count(h.doc_id) AS items, CASE WHEN count(h.doc_id) > 0 THEN 'written' ELSE 'nothing_matched' END AS disposition FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id",
    "redaction_residue": "SELECT 0::BIGINT AS n_left",
    "redacted_lengths": f"{IP} SELECT doc_id, length(any_value(n))::BIGINT AS n_chars, sum(length(matched_text))::BIGINT AS n_masked FROM ip JOIN n USING (doc_id) GROUP BY doc_id",
    "conversation_hits_by_role": f"WITH c AS (SELECT role, {_occurrences('that', 'lower(' + _norm('text') + ')')}::BIGINT AS k FROM conversations) SELECT role, sum(k)::BIGINT AS n_spans, count(*) AS n_turns FROM c WHERE k > 0 GROUP BY role",
    "pii_vs_labels": f"{BOTH} SELECT quality, count(*) AS n_docs, count(*) FILTER (doc_id IN (SELECT doc_id FROM hits)) AS n_hit FROM labels GROUP BY quality",
    "luhn_of_keys": f"SELECT o_orderkey, {LUHN} AS valid FROM (SELECT o_orderkey, string_split(o_orderkey::VARCHAR, '') AS d FROM orders)",
    "mask_functions": "SELECT n_nationkey, least(length(n_name), 12)::BIGINT AS n_line, least(greatest(length(n_name), 4), 18)::BIGINT AS n_value FROM nation",
}

_NINE = "lpad(o_orderkey::VARCHAR, 9, '0')"
ORACLES |= {
    "table_column_spans": f"""
      WITH c AS (SELECT o_orderkey AS doc_id, {_NINE} AS account, '1990-01-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') AS born, 'E-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS staff,
                        length('Staff list | Account | DOB | Staff no. | Room | |---|---|:-:|---| | ') AS a FROM orders)
      SELECT doc_id, 1 AS rule_line, a::INT AS start, (a + 9)::INT AS stop, account AS matched_text FROM c
      UNION ALL SELECT doc_id, 2, (a + 12)::INT, (a + 22)::INT, born FROM c
      UNION ALL SELECT doc_id, 3, (a + 27)::INT, (a + 33)::INT, staff FROM c""",
    "value_offsets": """
      WITH c AS (SELECT o_orderkey AS doc_id, 'API_TOKEN_' || lpad(o_orderkey::VARCHAR, 8, '0') AS token, '12-' || lpad(o_orderkey::VARCHAR, 7, '0') AS ein FROM orders WHERE o_orderkey % 2 = 0)
      SELECT doc_id, 2 AS rule_line, 19 AS start, 37 AS stop, token AS matched_text FROM c
      UNION ALL SELECT doc_id, 3, 54, 64, ein FROM c""",
    "original_offsets": """
      WITH c AS (SELECT o_orderkey AS doc_id, (o_orderkey % 5 + 1)::INT AS gap, '10.0.0.' || (o_orderkey % 250)::VARCHAR AS ip FROM orders)
      SELECT doc_id, 18 AS start, (18 + length(ip))::INT AS stop, (24 + gap)::INT AS original_start, (24 + gap + length(ip))::INT AS original_stop, ip AS original_text FROM c""",
    "plan_text": PLAN + """, p AS (SELECT doc_id, arg_min(matched_text, start) AS value FROM v GROUP BY doc_id)
      SELECT doc_id::VARCHAR AS source_name, '# Redaction plan: ' || doc_id || chr(10) || chr(10) || '1 of 1 items are ticked and will be removed.' || chr(10) || chr(10)
             || '## Page 1' || chr(10) || chr(10) || '- [x] `' || value || '` — ip addresses' || chr(10) AS body, value, 1 AS page FROM p""",
    "guidance_budget": """
      SELECT r_regionkey AS rules_id, (least(r_regionkey * 20 + 1, 3000 // 49) * 49 - 1)::BIGINT AS n_kept, (greatest(r_regionkey * 20 + 1 - 3000 // 49, 0) * 49)::BIGINT AS omitted_character_count FROM region""",
    "overlap_anti_join": """
      SELECT c.l_orderkey AS doc_id, c.l_linenumber::BIGINT AS line, (c.l_suppkey % 200)::BIGINT AS start FROM lineitem c WHERE c.l_linenumber % 2 = 0 AND NOT EXISTS (
        SELECT 1 FROM lineitem r WHERE r.l_orderkey = c.l_orderkey AND r.l_linenumber % 2 = 1 AND c.l_suppkey % 200 < r.l_partkey % 200 + 30 AND r.l_partkey % 200 < c.l_suppkey % 200 + 10)""",
    "recognised_boxes": """
      SELECT o_orderkey AS doc_id, unnest([60.0, 200.0])::DOUBLE AS x, unnest([0.0, 20.0])::DOUBLE AS y, unnest([10.0 * length(o_orderkey::VARCHAR), 30.0])::DOUBLE AS w, 10::DOUBLE AS h FROM orders WHERE o_orderkey % 3 <> 0
      UNION ALL SELECT o_orderkey, 60::DOUBLE, 0::DOUBLE, 10.0 * length(o_orderkey::VARCHAR), 10::DOUBLE FROM orders WHERE o_orderkey % 3 = 0""",
    "plan_values_redacted": PLAN + ", t AS (SELECT DISTINCT doc_id, matched_text FROM v WHERE NOT starts_with(matched_text, '1')) "
    "SELECT doc_id, sum(c * length(matched_text))::BIGINT AS n_masked FROM (SELECT doc_id, matched_text, (length(n) - length(replace(n, matched_text, ''))) // length(matched_text) AS c FROM t JOIN n USING (doc_id)) GROUP BY doc_id",
}
