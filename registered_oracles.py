"""DuckDB SQL for the registered queries, written from the operator semantics."""

from __future__ import annotations

from clauselake.catalog import (
    BREADTH_QUERIES,
    CHECKLIST,
    COMPANY_HINTS,
    CONCLUSION_TITLES,
    CRITERION_CODES,
    FIELD_TABLE,
    GUARD_FACTS,
    INSURER_HEADER_LINES,
    PRICE_REFERENCE_DATE,
    RANKING_CRITERIA,
    REPORT_CATEGORIES,
    REPORT_FIELD_TABLE,
    SENSITIVITY_SCENARIOS,
    STOPWORDS,
    TITLE_MARKERS,
)
from clauselake.sources.derived import CELL_STATUSES


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(text: str) -> str:
    return f"trim({text}, E' \\t\\n\\r')"


def fold(text: str) -> str:
    return f"regexp_replace(strip_accents(lower({strip(text)})), '\\s+', ' ', 'g')"


FIELDS = "(VALUES " + ", ".join(
    f"({i}, {lit(code)}, {lit(kind)}, {lit('' if unit == '-' else unit)}, {lit(label)}, {lit(text)})"
    for i, (code, kind, unit, label, text) in enumerate(FIELD_TABLE, start=1)
) + ") f(ordinal, field_code, field_type, unit, label, description)"

# --- pages and chunks

PAGES = """
pages_v AS (
  SELECT source AS policy_id, source AS document_id, doc_id + 1 AS page_number, doc_id,
         CASE WHEN doc_id % 3 = 0 THEN 'Cláusula ' || doc_id || chr(10) || text ELSE text END AS body,
         doc_id % 7 = 0 AS scanned, doc_id % 14 = 0 AS laid_out, (doc_id % 100) / 100.0 AS conf
  FROM documents),
native_v AS (
  SELECT *, CASE WHEN scanned THEN 'p. ' || doc_id ELSE body END AS native FROM pages_v)
"""
NATIVE_OK = f"length({strip('native')}) >= 40"
RESOLVED = f"""
{PAGES},
resolved AS (
  SELECT policy_id, document_id, page_number,
         CASE WHEN NOT ({NATIVE_OK}) AND laid_out THEN 'Artigo ' || doc_id || chr(10) || {strip('body')}
              WHEN {NATIVE_OK} THEN native ELSE CASE WHEN scanned THEN body ELSE '' END END AS text,
         CASE WHEN NOT ({NATIVE_OK}) AND laid_out THEN 'PP_STRUCTURE'
              WHEN {NATIVE_OK} THEN 'NATIVE_TEXT' ELSE 'PADDLEOCR' END AS source_type,
         NOT ({NATIVE_OK}) AS used_ocr,
         CASE WHEN NOT ({NATIVE_OK}) AND scanned THEN conf END AS ocr_confidence
  FROM native_v)
"""


def cut(table: str) -> str:
    """Pieces of 800 characters every 700 over the whole text, empty ones dropped before counting."""
    return f"""
pieces AS (
  SELECT * EXCLUDE (body_, w, raw_piece), row_number() OVER (PARTITION BY document_id, page_number ORDER BY w) - 1 AS chunk_index,
         raw_piece AS text
  FROM (SELECT *, {strip("substr(body_, w * 700 + 1, 800)")} AS raw_piece
        FROM (SELECT * EXCLUDE (text), {strip('text')} AS body_,
                     unnest(range(0, greatest(0, ceil((length({strip('text')}) - 800) / 700.0))::BIGINT + 1)) AS w
              FROM {table}))
  WHERE raw_piece <> '')
"""


SINGLE = f"""
single AS (SELECT doc_id::VARCHAR AS policy_id, doc_id::VARCHAR AS document_id, 1 AS page_number, text FROM documents),
{cut('single')}
"""
MARKER = r"(?im)^[ \t]*(?:cl[áa]usula|artigo|se[çc][ãa]o|ep[íi]grafe)\b[^\n]*"
CHUNKS = f"""
{RESOLVED},
{cut('resolved')},
marked AS (SELECT *, list_transform(regexp_extract_all(text, '{MARKER}'), lambda m: {strip('m')}) AS marks FROM pieces),
carried AS (
  SELECT *, last_value(CASE WHEN len(marks) > 0 THEN marks[-1] END IGNORE NULLS) OVER (
      PARTITION BY document_id ORDER BY page_number, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inherited
  FROM marked),
chunks_v AS (
  SELECT document_id || ':p' || page_number || ':c' || chunk_index AS chunk_id, policy_id, document_id, page_number,
         chunk_index, source_type, ocr_confidence, text,
         CASE WHEN len(marks) > 0 AND starts_with(text, marks[1]) THEN marks[1] ELSE inherited END AS section_name
  FROM carried)
"""
SECTION_POLICY = "'pol' || (doc_id // 8)"
SECTIONS = f"""
md AS (SELECT {SECTION_POLICY} AS policy_id, doc_id + 1 AS page_number, regexp_replace(text, '(?m)^([DEL])', '## \\1', 'g') AS md FROM documents),
lines_v AS (SELECT policy_id, page_number, unnest(string_split(md, chr(10))) AS line, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS n FROM md),
headed AS (SELECT *, regexp_matches(line, '^#{{1,4}}[ \\t]+\\S') AS is_head FROM lines_v),
blocks AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY policy_id, page_number ORDER BY n) AS block FROM headed),
bodies AS (
  SELECT policy_id, page_number, block,
         max(CASE WHEN is_head THEN {strip("regexp_extract(line, '^#{1,4}[ \\t]+(.*)$', 1)")} END) AS title,
         {strip("coalesce(string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY n), '')")} AS text
  FROM blocks GROUP BY ALL),
sections AS (
  SELECT policy_id, page_number, row_number() OVER (PARTITION BY policy_id, page_number ORDER BY block) - 1 AS section_index, title, text
  FROM bodies WHERE text <> '')
"""
QUOTED = "text"
EVIDENCE_ID = "'ev_md_' || policy_id || ':p' || page_number || ':s' || section_index"
READING = f"""
{SECTIONS},
reading AS (
  SELECT * FROM (SELECT *, {EVIDENCE_ID} AS evidence_id, row_number() OVER (PARTITION BY policy_id ORDER BY page_number, section_index) AS rank FROM sections)
  WHERE rank <= 20)
"""


def terms(text: str) -> str:
    folded = f"strip_accents(replace(lower({text}), 'ß', 'ss'))"
    return f"list_distinct(list_filter(regexp_split_to_array({folded}, '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({listed(STOPWORDS)}, t)))"


RANKED = f"""
{SECTIONS},
wanted AS (SELECT field_code, {terms("label || ' ' || description")} AS q FROM {FIELDS}),
scored AS (
  SELECT policy_id, field_code, page_number, section_index, title, text,
         len(list_intersect(q, s))::DOUBLE / len(q) AS retrieval_score
  FROM (SELECT *, {terms("coalesce(title, '') || ' ' || text")} AS s FROM sections), wanted),
ranked AS (
  SELECT * FROM (SELECT *, {EVIDENCE_ID} AS evidence_id,
      row_number() OVER (PARTITION BY policy_id, field_code ORDER BY retrieval_score DESC, page_number, section_index) AS rank FROM scored)
  WHERE rank <= 6)
"""

# --- retrieval


def buckets(text: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: t <> ''), lambda t: ('0x' || substr(sha256(t), 7, 2))::INT % 32)"


def embed(text: str) -> str:
    return f"list_transform(range(32), lambda b: len(list_filter({buckets(text)}, lambda x: x = b))::DOUBLE)"


def cosine(a: str, b: str) -> str:
    return f"(CASE WHEN list_sum({a}) = 0 OR list_sum({b}) = 0 THEN 0.0 ELSE round(list_cosine_similarity({a}, {b}), 6) + 0.0 END)"


QUESTIONS = """
questions AS (SELECT conv_id || '-' || turn AS query_id, conv_id, text AS query FROM conversations WHERE role = 'user')
"""
VECTORS = f"""
{CHUNKS},
tokens AS MATERIALIZED (SELECT *, {buckets('text')} AS bs FROM chunks_v),
vectors AS MATERIALIZED (
  SELECT * EXCLUDE (bs), list_transform(range(32), lambda b: len(list_filter(bs, lambda x: x = b))::DOUBLE) AS v FROM tokens)
"""


def search(queries: str, k: int, condition: str = "TRUE") -> str:
    """Best chunks per row of ``queries(query_id, v, ..)``."""
    return f"""
hits AS (
  SELECT * FROM (
    SELECT q.query_id, c.chunk_id, c.policy_id, c.page_number, c.source_type, c.section_name, c.text AS quoted_text,
           {cosine('q.v', 'c.v')} AS score,
           row_number() OVER (PARTITION BY q.query_id ORDER BY {cosine('q.v', 'c.v')} DESC, c.chunk_id) AS rank
    FROM {queries} q JOIN vectors c ON {condition})
  WHERE rank <= {k})
"""


# --- facts of customers

MONEY_FORMS = {"limite_agregado": "total", "limite_por_sinistro": "largest", "franquia": "smallest", "limite_defesa_custos": "c_acctbal"}
FACTS = f"""
order_sums AS (
  SELECT o_custkey AS k, sum(o_totalprice::DECIMAL(38,2))::DECIMAL(38,2) AS total, max(o_totalprice::DECIMAL(38,2)) AS largest,
         min(o_totalprice::DECIMAL(38,2)) AS smallest, count(*) AS n, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last
  FROM orders GROUP BY 1),
base AS (
  SELECT c.c_custkey AS k, c.c_acctbal::DECIMAL(38,2) AS balance, c.c_mktsegment AS segment, r.r_name, s.* EXCLUDE (k),
         ['BRL','USD','EUR','XXX'][c.c_nationkey % 4 + 1] AS cur
  FROM customer c LEFT JOIN order_sums s ON s.k = c.c_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey),
typed AS (
  SELECT k, f.ordinal, f.field_code, f.field_type, f.unit,
    CASE f.field_code WHEN 'limite_agregado' THEN total WHEN 'limite_por_sinistro' THEN largest WHEN 'franquia' THEN smallest
                      WHEN 'limite_defesa_custos' THEN balance END AS amount,
    CASE WHEN f.field_type <> 'money' THEN NULL
         WHEN f.field_code = 'franquia' AND k % 11 = 0 THEN CASE WHEN cur = 'BRL' THEN 'USD' ELSE 'BRL' END ELSE cur END AS currency,
    CASE f.field_code WHEN 'prazo_notificacao_sinistro' THEN n::VARCHAR WHEN 'indice_reajuste' THEN (k % 7) || '.50' END AS number_text,
    CASE WHEN f.field_code = 'retroatividade' THEN first END AS date,
    CASE WHEN f.field_code = 'vigencia' THEN first END AS start_date, CASE WHEN f.field_code = 'vigencia' THEN last END AS end_date,
    CASE f.field_code
      WHEN 'extensao_territorial' THEN CASE r_name WHEN 'AMERICA' THEN 'america do sul' WHEN 'EUROPE' THEN 'europa' WHEN 'AFRICA' THEN 'exterior'
                                                   WHEN 'ASIA' THEN 'asia' ELSE 'oriente medio' END
      WHEN 'exclusoes_chave' THEN 'exclusao ' || lower(segment) END AS text,
    (k + f.ordinal) % 19 = 0 AS flagged
  FROM base, {FIELDS}),
stated AS (
  SELECT *, CASE WHEN (k + ordinal) % 17 = 0 OR (amount IS NULL AND number_text IS NULL AND date IS NULL AND start_date IS NULL AND text IS NULL) THEN 'NOT_FOUND'
                 WHEN (k + ordinal) % 13 = 0 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS status0 FROM typed),
valued AS (
  SELECT *, k::VARCHAR AS policy_id, CASE WHEN status0 = 'FOUND' THEN
      CASE field_type WHEN 'money' THEN 'amount=' || amount || ', currency=' || currency WHEN 'number' THEN 'number=' || number_text
        WHEN 'date' THEN 'date=' || date WHEN 'text' THEN 'text=' || text
        ELSE 'duration_days=' || (end_date - start_date) || ', end=' || end_date || ', start=' || start_date END END AS value,
      CASE WHEN status0 <> 'NOT_FOUND' THEN 'ev_' || k || '_' || ordinal END AS evidence_id
  FROM stated),
ruled AS (
  SELECT *, list_filter([
      CASE WHEN amount < 0 OR number_text::DECIMAL(38,10) < 0 THEN 'valor_positivo' END,
      CASE WHEN field_code <> 'franquia' AND (amount = 0 OR number_text::DECIMAL(38,10) = 0) THEN 'valor_positivo' END,
      CASE WHEN currency = 'XXX' THEN 'moeda_conhecida' END,
      CASE WHEN field_code = 'extensao_territorial' AND text IN ('asia', 'oriente medio') THEN 'enum_base_territorial' END],
      lambda r: r IS NOT NULL AND status0 = 'FOUND') AS own_rules
  FROM valued),
once AS (SELECT *, CASE WHEN len(own_rules) > 0 THEN 'NEEDS_REVIEW' ELSE status0 END AS status1 FROM ruled),
mixed AS (SELECT k FROM once WHERE field_type = 'money' AND status1 = 'FOUND' GROUP BY 1 HAVING count(DISTINCT currency) > 1),
facts_v AS (
  SELECT o.*, CASE WHEN x THEN 'NEEDS_REVIEW' ELSE status1 END AS status, flagged OR len(own_rules) > 0 OR x AS review,
         CASE WHEN x THEN list_append(own_rules, 'moeda_consistente') ELSE own_rules END AS rules,
         'FAC-' || policy_id || '-' || field_code AS fact_id
  FROM (SELECT *, field_type = 'money' AND status1 = 'FOUND' AND k IN (SELECT k FROM mixed) AS x FROM once) o)
"""
PAIRS = "pairs_v AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer))"


def grid(status: str, review: str, rate: str) -> str:
    """Comparison grid with results; ``rate`` maps a currency to its rate."""
    brl = lambda s: f"CASE WHEN {s}.currency = 'BRL' THEN {s}.amount ELSE round({s}.amount * ({rate.format(c=s + '.currency')})::DECIMAL(18,8), 2) END"
    order = lambda x, y: f"CASE WHEN {x} > {y} THEN 'MAIOR' WHEN {x} < {y} THEN 'MENOR' WHEN {x} = {y} THEN 'IGUAL' END"
    pending = lambda s: f"({s}.{review} OR {s}.{status} IN ('AMBIGUOUS', 'NEEDS_REVIEW'))"
    days = lambda s: f"({s}.end_date - {s}.start_date)"
    return f"""
grid_v AS (
  SELECT p.a, p.b, a.ordinal, a.field_code, a.field_type, a.value AS valor_a, b.value AS valor_b, a.evidence_id AS ev_a, b.evidence_id AS ev_b,
    CASE WHEN {pending('a')} OR {pending('b')} THEN 'AGUARDANDO_REVISAO'
         WHEN a.{status} = 'NOT_FOUND' AND b.{status} = 'NOT_FOUND' THEN 'AUSENTES_AMBOS'
         WHEN a.{status} = 'NOT_FOUND' THEN 'AUSENTE_A' WHEN b.{status} = 'NOT_FOUND' THEN 'AUSENTE_B'
         WHEN a.field_type = 'money' THEN {order(brl('a'), brl('b'))}
         WHEN a.field_type = 'number' THEN {order('a.number_text::DECIMAL(38,10)', 'b.number_text::DECIMAL(38,10)')}
         WHEN a.field_type = 'date' THEN {order('a.date', 'b.date')}
         WHEN a.field_type = 'text' THEN CASE WHEN a.text = b.text THEN 'IGUAL' ELSE 'DIVERGENTE' END
         WHEN a.start_date = b.start_date AND a.end_date = b.end_date THEN 'IGUAL'
         WHEN {days('a')} = {days('b')} THEN 'DIVERGENTE' ELSE {order(days('a'), days('b'))} END AS resultado
  FROM pairs_v p JOIN facts_v a ON a.k = p.a JOIN facts_v b ON b.k = p.b AND b.ordinal = a.ordinal)
"""


DIRECTION = "CASE resultado WHEN 'MAIOR' THEN 'A' WHEN 'MENOR' THEN 'B' WHEN 'IGUAL' THEN 'igual' ELSE CASE WHEN resultado IS NOT NULL THEN 'n/a' END END"
RATE = "CASE {c} WHEN 'USD' THEN '5.25' WHEN 'EUR' THEN '6.10' END"
COMPARED = f"{FACTS}, {PAIRS}, {grid('status', 'review', RATE)}"


def uuid5(name: str) -> str:
    digest = f"sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode({name}))"
    variant = f"lower(hex((('0x' || substr({digest}, 17, 2))::INT & 63) | 128))"
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
        f"{variant} || substr({digest}, 19, 2) || '-' || substr({digest}, 21, 12)"
    )


COMPARISON_ID = uuid5("'comparison:' || a || '|' || b")

# --- reviews

DECISIONS = f"""
decided AS (
  SELECT event_id AS seq, ts, f.field_code, f.field_type,
         CASE WHEN event_id % 50 = 49 THEN 'FAC-x-' ELSE 'FAC-' || user_id || '-' END || f.field_code AS fact_id,
         CASE event_type WHEN 'click' THEN 'CONFIRMADO' WHEN 'purchase' THEN 'CORRIGIDO' WHEN 'error' THEN 'CORRIGIDO' WHEN 'view' THEN 'DIVERGENTE' ELSE 'OUTRO' END AS decision,
         event_type IN ('click', 'purchase') AS given, 'rev' || user_id % 5 AS decided_by, value::DECIMAL(18,2) AS amount,
         CASE WHEN event_id % 3 = 0 THEN 'nota' END AS note
  FROM events, {FIELDS} WHERE f.ordinal = event_id % 10 + 1),
judged AS (
  SELECT d.*, t.fact_id IS NOT NULL AS known, t.currency,
    CASE WHEN d.decision = 'OUTRO' THEN 'INVALID_DECISION' WHEN t.fact_id IS NULL THEN 'UNKNOWN_FACT'
         WHEN d.decision = 'CORRIGIDO' AND NOT given THEN 'VALUE_REQUIRED'
         WHEN d.decision = 'CORRIGIDO' AND ((d.field_type = 'text' AND seq % 2 = 1) OR (d.field_type = 'period' AND d.ts::DATE < DATE '2024-01-01')) THEN 'NORMALIZATION_ERROR'
         WHEN d.decision = 'CORRIGIDO' AND ((d.field_type = 'money' AND t.currency = 'XXX') OR (d.field_type IN ('money', 'number') AND d.amount = 0 AND d.field_code <> 'franquia')) THEN 'RULE_VIOLATION' END AS reason,
    CASE d.field_type WHEN 'money' THEN 'amount=' || d.amount || ', currency=' || coalesce(t.currency, 'BRL') WHEN 'number' THEN 'number=' || d.amount::DOUBLE::VARCHAR
      WHEN 'period' THEN 'duration_days=' || (d.ts::DATE - DATE '2024-01-01') || ', end=' || d.ts::DATE || ', start=2024-01-01'
      WHEN 'date' THEN 'date=' || d.ts::DATE ELSE 'text=brasil' END AS new_value
  FROM decided d LEFT JOIN (
    SELECT fact_id, CASE WHEN amount IS NOT NULL THEN currency END AS currency FROM facts_v) t ON t.fact_id = d.fact_id),
merged AS (
  SELECT fact_id, arg_max(decision, (ts, seq)) AS decision, arg_max(decided_by, (ts, seq)) AS decided_by, max(ts) AS ts,
         arg_max(coalesce(note, ''), (ts, seq)) AS note,
         arg_max(new_value, (ts, seq)) FILTER (decision = 'CORRIGIDO') AS corrected, bool_or(decision <> 'DIVERGENTE') AS resolved
  FROM judged WHERE reason IS NULL GROUP BY 1)
"""

# --- document answers

LAST_LINE = strip(f"string_split({strip('text')}, chr(10))[-1]")
LAST_CHUNK = f"greatest(0, ceil((length({strip('text')}) - 800) / 700.0))::BIGINT"
BUILT = f"""
{SINGLE},
said AS (SELECT conv_id, {strip('text')} AS said FROM conversations WHERE turn = 0),
docs AS (SELECT d.doc_id, d.n_chars, {LAST_LINE} AS quote, {LAST_CHUNK} AS last_chunk, s.said FROM documents d LEFT JOIN said s ON s.conv_id = d.doc_id),
cited AS (
  SELECT d.*, c.texts FROM docs d LEFT JOIN (
    SELECT document_id, list(text) AS texts FROM (
      SELECT p.document_id, p.text FROM pieces p JOIN docs d ON d.doc_id::VARCHAR = p.document_id AND p.chunk_index IN (0, d.last_chunk)) GROUP BY 1) c
  ON c.document_id = d.doc_id::VARCHAR),
answered AS (
  SELECT doc_id, f.*, CASE f.pos WHEN 0 THEN list_filter([quote, said], lambda q: q IS NOT NULL AND q <> '') WHEN 1 THEN [] ELSE list_filter([quote], lambda q: q <> '') END AS quotes,
         texts, n_chars, quote
  FROM cited, (VALUES (0, 'limite_agregado'), (1, 'prazo_notificacao_sinistro'), (2, 'exclusoes_chave')) f(pos, field_code)),
anchored AS (SELECT *, len(list_filter(quotes, lambda q: len(list_filter(texts, lambda t: contains(t, q))) = 0)) AS bad FROM answered),
bad_docs AS (
  SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'limite_agregado' ELSE 'prazo_notificacao_sinistro' END AS field_code,
         CASE WHEN doc_id % 29 = 0 THEN 'EVIDENCE_UNKNOWN' ELSE 'LLM_SCHEMA_INVALID' END AS error_code
  FROM documents WHERE doc_id % 29 = 0 OR doc_id % 31 = 0)
"""

ISSUES = f"""
{FACTS},
issues_v AS (
  SELECT policy_id, field_code, 'ALTO' AS severity, 2 AS severity_rank,
         'regra de campo violada: ' || rule || ': ' || CASE rule WHEN 'moeda_conhecida' THEN 'moeda fora do conjunto conhecido'
           WHEN 'moeda_consistente' THEN 'campos monetários da mesma apólice com moedas distintas' WHEN 'enum_base_territorial' THEN 'valor fora do enum de extensão territorial'
           ELSE CASE WHEN amount < 0 OR number_text::DECIMAL(38,10) < 0 THEN 'valor negativo é inválido' ELSE 'campo exige valor estritamente positivo' END END AS reason
  FROM (SELECT *, unnest(rules) AS rule FROM facts_v)
  UNION ALL
  SELECT policy_id, field_code, CASE WHEN status IN ('NEEDS_REVIEW', 'AMBIGUOUS') THEN 'MÉDIO' ELSE 'BAIXO' END, CASE WHEN status IN ('NEEDS_REVIEW', 'AMBIGUOUS') THEN 3 ELSE 4 END,
         CASE status WHEN 'NEEDS_REVIEW' THEN 'valor ilegível/incerto (NEEDS_REVIEW)' WHEN 'AMBIGUOUS' THEN 'trechos conflitantes (AMBIGUOUS)' ELSE 'sinalizado pelo LLM para revisão (sem violação de regra)' END
  FROM facts_v WHERE len(rules) = 0 AND (status IN ('NEEDS_REVIEW', 'AMBIGUOUS') OR review))
"""
FAILURES = """
failures_v AS (
  SELECT 'doc' || d.doc_id AS policy_id, f.field_code, 'CRÍTICO' AS severity, 1 AS severity_rank,
         CASE WHEN d.doc_id % 29 = 0 THEN 'EVIDENCE_UNKNOWN' ELSE 'LLM_SCHEMA_INVALID' END AS reason
  FROM documents d, (VALUES ('limite_agregado'), ('prazo_notificacao_sinistro'), ('exclusoes_chave')) f(field_code)
  WHERE d.doc_id % 29 = 0 OR d.doc_id % 31 = 0)
"""
COUNTS = ", ".join(
    f"count(*) FILTER (severity = '{s}') AS {n}" for s, n in (("CRÍTICO", "critico"), ("ALTO", "alto"), ("MÉDIO", "medio"), ("BAIXO", "baixo"))
)

USAGE = """
usage_v AS (
  SELECT user_id AS run_id, event_type AS kind, event_id AS seq, floor(value * 100)::BIGINT AS tin, floor(value * 10)::BIGINT AS tout,
         (props->>'$.k')::BIGINT * 3 AS latency, (props->>'$.k')::BIGINT % 3 AS m FROM events),
cost_v AS (
  SELECT *, CASE m WHEN 0 THEN round(tin * 0.10 + tout * 0.40)::DOUBLE / 1000000 WHEN 1 THEN round(tin * 0.43 + tout * 0.87)::DOUBLE / 1000000 END AS cost_usd
  FROM usage_v)
"""

COVERS = """
covers AS (
  SELECT c.c_custkey AS k, c.c_custkey::VARCHAR AS policy_id, c.c_nationkey AS scope, c.c_mktsegment AS seg, c.c_name, o.last,
         upper(substr(c.c_mktsegment, 1, 1)) || lower(substr(c.c_mktsegment, 2)) AS seg_title,
         CASE r.r_name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(substr(r.r_name, 1, 1)) || lower(substr(r.r_name, 2)) END AS brand
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey),
read_names AS (
  SELECT k, policy_id, 1 AS line_number, CASE WHEN k % 3 = 0 THEN brand || ' Seguros S.A.' ELSE brand END AS name, NULL::VARCHAR AS year FROM covers
  UNION ALL SELECT k, policy_id, 2, brand || ' seguros', NULL FROM covers WHERE k % 4 = 0
  UNION ALL SELECT k, policy_id, 3, NULL, year(last)::VARCHAR FROM covers WHERE last IS NOT NULL
  UNION ALL SELECT k, policy_id, CASE WHEN last IS NULL THEN 3 ELSE 4 END, seg_title, NULL FROM covers WHERE k % 7 = 0),
detected AS (
  SELECT k, policy_id, CASE WHEN k % 3 = 0 THEN brand || ' Seguros S.A.' WHEN k % 4 = 0 THEN brand || ' seguros' ELSE brand END AS name, year(last)::VARCHAR AS year
  FROM covers WHERE k % 7 <> 0)
"""

# --- reports

REPORT_FIELDS = "(VALUES " + ", ".join(
    f"({i}, {lit(code)}, {lit(category)})" for i, (code, category, _, _) in enumerate(REPORT_FIELD_TABLE, start=1)
) + ") f(ordinal, field_code, category)"
CELLS = f"""
raw_cells AS (
  SELECT s_suppkey AS k, s_nationkey, f.*, s_suppkey + ordinal AS p, {listed(CELL_STATUSES)}[(s_suppkey + ordinal) % 7 + 1] AS raw_status,
         (s_suppkey + ordinal) % 4 <> 1 AS answered FROM supplier, {REPORT_FIELDS}),
cells AS (
  SELECT k, s_nationkey, ordinal, field_code, category, answered, p,
    CASE WHEN NOT answered THEN 'Não localizado' WHEN p % 5 = 0 AND raw_status <> 'Não localizado' THEN 'Requer confirmação'
         ELSE CASE raw_status WHEN 'EXCLUIDO' THEN 'Excluído' WHEN 'condicionado' THEN 'Condicionado' WHEN 'ambiguo' THEN 'Ambíguo'
              WHEN 'NAO_APLICAVEL' THEN 'Não aplicável' WHEN 'Talvez' THEN 'Requer confirmação' ELSE raw_status END END AS status,
    CASE WHEN answered AND p % 3 = 0 THEN 'até ' || p END AS limite_franquia, CASE WHEN answered AND p % 4 = 0 THEN '| ressalva' END AS exclusoes_condicoes,
    CASE WHEN answered AND p % 5 <> 0 THEN 'doc ' || k || ' · pág. ' || ordinal END AS referencia,
    CASE WHEN NOT answered THEN 'nao_localizado' WHEN p % 5 = 0 AND raw_status <> 'Não localizado' THEN 'requer_confirmacao'
         WHEN p % 6 = 0 THEN 'interpretacao' WHEN raw_status = 'Não localizado' THEN 'nao_localizado' ELSE 'fato' END AS origem
  FROM raw_cells)
"""
WEIGHTS = "(VALUES " + ", ".join(f"({i}, {lit(code)}, {weight})" for i, (code, weight, _) in enumerate(RANKING_CRITERIA, start=1)) + ") w(ordinal, criterion, weight)"
SCENARIOS = "(VALUES " + ", ".join(
    f"({lit(name)}, {i}, {weight} * 100 / {sum(weights)})"
    for name, weights in SENSITIVITY_SCENARIOS.items() for i, weight in enumerate(weights, start=1)
) + ") w(scenario, ordinal, weight)"
NOTE = "(((s_suppkey * 7 + ordinal * 3) % 101) / 10.0)"
TOTAL = f"round(sum(round({NOTE}::DOUBLE * weight::DOUBLE / 10.0, 9)::DECIMAL(20,9)), 6)::DECIMAL(20,6)"
SMALL_NATION = "SELECT DISTINCT s_nationkey AS n FROM supplier"

EVALUATED = f"""
{SINGLE},
expected AS (
  SELECT d.doc_id, d.n_chars, l.quality, l.toxic, {LAST_LINE} AS quote, {LAST_CHUNK} AS last_chunk FROM labels l JOIN documents d USING (doc_id)),
entries AS (
  SELECT e.*, CASE WHEN quality = 1 THEN 'FOUND' ELSE 'NOT_FOUND' END AS expected_status,
         CASE WHEN e.doc_id % 11 = 0 THEN NULL WHEN e.doc_id % 5 = 0 THEN 'NOT_FOUND' WHEN e.doc_id % 5 = 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS extracted_status,
         coalesce(contains(p.text, quote), FALSE) AS hit
  FROM expected e LEFT JOIN pieces p ON p.document_id = e.doc_id::VARCHAR AND p.chunk_index = e.last_chunk),
results AS (
  SELECT *, CASE WHEN extracted_status IS NULL THEN 'nao_avaliado'
      WHEN extracted_status = 'NOT_FOUND' THEN CASE WHEN expected_status = 'NOT_FOUND' THEN 'correto' ELSE 'ausente' END
      WHEN extracted_status = 'AMBIGUOUS' THEN 'inconclusivo' WHEN expected_status = 'NOT_FOUND' THEN 'divergente'
      WHEN toxic = 0 THEN 'correto' ELSE 'divergente' END AS result,
    CASE WHEN extracted_status IS NOT NULL THEN quality = 0 OR quote = '' OR hit END AS evidence_ok
  FROM entries)
"""

amount_sql = "o_totalprice::DECIMAL(18,2)"
number_sql = f"""CASE WHEN k < 3 THEN a::VARCHAR WHEN k = 3 THEN a || (o_orderkey % 10)::VARCHAR WHEN k = 5 THEN '-' || a END"""
printed_sql = f"""CASE k WHEN 0 THEN 'R$ ' || translate(format('{{:,.2f}}', a::DOUBLE), ',.', '.,') WHEN 1 THEN format('{{:,.2f}}', a::DOUBLE)
  WHEN 2 THEN a::VARCHAR WHEN 3 THEN a || ' % ou ' || (o_orderkey % 10) WHEN 4 THEN '1.000.' || o_orderkey WHEN 5 THEN '-' || replace(a::VARCHAR, '.', ',') ELSE 'sem valor' END"""


def br(number: str, decimals: bool) -> str:
    whole = f"replace(format('{{:,}}', trunc(abs({number}))::BIGINT), ',', '.')"
    return f"CASE WHEN {number} < 0 THEN '-' ELSE '' END || {whole}" + (
        f" || ',' || lpad((round(abs({number}) * 100) % 100)::BIGINT::VARCHAR, 2, '0')" if decimals else ""
    )


EVIDENCE_LINE = f"""'- [' || evidence_id || '] pág. ' || page_number || CASE WHEN coalesce(title, '') <> '' THEN ' seção ' || title ELSE '' END || ': "' || {QUOTED} || '"'"""
EXTRACTION_HEAD = (
    "Extraia os campos pedidos de uma apólice de seguro.\nDevolva apenas JSON, sem texto ao redor, na forma "
    '{"facts": [{"field_code", "status", "value", "confidence", "evidence_ids", "requires_human_review"}]}.\n'
    "status: FOUND, NOT_FOUND, AMBIGUOUS ou NEEDS_REVIEW.\nCite somente os identificadores de evidência listados abaixo.\n\n"
)
FINDINGS_HEAD = (
    "Liste achados relevantes da apólice que não fazem parte do catálogo de campos.\nDevolva apenas JSON, sem texto ao redor, na forma "
    '{"findings": [{"label", "value", "detail", "evidence_ids"}]}.\nCite somente os identificadores de evidência listados abaixo.\n\n## Seções\n'
)
EXPLANATION_HEAD = (
    "Explique a um analista a diferença entre duas apólices.\nDevolva apenas JSON, sem texto ao redor, na forma "
    '{"text", "evidence_ids"}.\nCite evidências dos dois lados quando houver.\n'
)
JSON_HEAD = "Devolva apenas JSON, sem texto ao redor, na forma"
GUESS_LINE = 'O que não constar do material fica nulo ou "Não localizado"; não complete por suposição.'
IDENTIFICATION_HEAD = (
    "Identifique o documento de apólice.\n"
    + JSON_HEAD
    + " {seguradora, produto, processo_susep, versao_data, publico_alvo, empresa_aberta_fechada, "
    "secoes_natureza, num_paginas, coberturas_descritas, limitacoes, ausentes}.\n" + GUESS_LINE + "\n\n"
)


def fill_head(code: str, label: str) -> str:
    fields = "".join(f"- {f}: {text} ({weight})\n" for f, c, weight, text in REPORT_FIELD_TABLE if c == code)
    return (
        f"Preencha a matriz de comparação na categoria {label} ({code}), uma célula por campo.\n{JSON_HEAD} "
        '{"cells": [{"field_code", "status", "limite_franquia", "exclusoes_condicoes", "impacto_pratico", "impacto_financeiro", "referencia", "origem"}]}.\n'
        f'{GUESS_LINE}\nTodo status diferente de "Não localizado" exige referencia.\n\n{fields}\n## Seções'
    )


REPORT_HEADS = {
    "tables": "Monte as 5 tabelas especiais do relatório, uma para cada code abaixo.\n" + JSON_HEAD
    + ' {"tables": [{"code", "title", "rows": [{"label", "cells": {policy_id: texto ou null}}]}]}.\n'
    "- pessoas_protegidas: quem é coberto\n- limites: limites, sublimites e franquias\n- matriz_temporal: base de reclamação, retroatividade e notificação\n"
    "- exclusoes_criticas: exclusões críticas\n- coberturas_sociedade: cobertura da sociedade e reembolso\n" + GUESS_LINE + "\n",
    "scenarios": "Descreva 3 cenários hipotéticos de sinistro e o que cada documento prevê em cada um.\n" + JSON_HEAD
    + ' {"scenarios": [{"name", "policy_findings": {policy_id: texto}}]}.\nSão hipóteses: não afirme que a seguradora aceitaria a cobertura.\n' + GUESS_LINE + "\n",
    "scores": "Dê a cada apólice uma nota de 0 a 10 por critério, apoiada nos documentos.\n" + JSON_HEAD + ' {"notes": {policy_id: {criterio: nota}}}.\n'
    + "".join(f"- {code}: {label} (peso {weight})\n" for code, weight, label in RANKING_CRITERIA) + GUESS_LINE + "\n",
    "conclusions": "Escreva as conclusões com exatamente estas 8 chaves; vantagens e desvantagens são objetos por documento, as outras são listas.\n"
    + "".join(f"- {key}: {title}\n" for key, title in CONCLUSION_TITLES) + "Sem dado financeiro nos documentos, não conclua sobre preço.\n" + GUESS_LINE + "\n",
}
QUESTION_HEAD = (
    "Responda à pergunta do analista apenas com base nas evidências.\nCite somente os identificadores de evidência listados abaixo.\n"
    'Devolva apenas JSON, sem texto ao redor, na forma {"text", "evidence_ids"}.\n\n## Pergunta\n'
)


ORACLES: dict[str, str] = {
    "fold_text": f"SELECT doc_id, md5({fold('text')}) AS folded_md5, length({fold('text')})::INT AS folded_chars FROM documents",
    "parse_numbers": f"""SELECT o_orderkey, {printed_sql} AS raw, ({number_sql})::DECIMAL(38,10)::VARCHAR AS number,
        round(({number_sql})::DECIMAL(38,10), 2)::DECIMAL(38,2)::VARCHAR AS amount, {number_sql} AS number_text
        FROM (SELECT *, o_orderkey % 7 AS k, {amount_sql} AS a FROM orders)""",
    "parse_dates": """SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%d/%m/%Y')
          WHEN 2 THEN ' ' || day(d) || '-' || month(d) || '-' || year(d) || ' ' WHEN 3 THEN strftime(d, '%Y/%m/%d')
          WHEN 4 THEN '31/02/' || year(d) ELSE strftime(d, '%d/%m-%Y') END AS raw,
        CASE WHEN k < 3 THEN d::VARCHAR END AS iso_date
        FROM (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderdate::DATE AS d FROM orders)""",
    "normalize_values": f"WITH {FACTS} SELECT policy_id, field_code, status0 AS status, value FROM facts_v",
    "format_values": f"""WITH {FACTS} SELECT policy_id, field_code, CASE WHEN status0 <> 'FOUND' THEN '—' ELSE CASE field_type
          WHEN 'money' THEN CASE currency WHEN 'BRL' THEN 'R$' WHEN 'USD' THEN 'US$' WHEN 'EUR' THEN '€' ELSE currency END || ' ' || {br('amount', True)}
          WHEN 'number' THEN CASE WHEN unit = '%' THEN (k % 7) || ',5%' ELSE {br('number_text::DECIMAL(38,10)', False)} || ' dias' END
          WHEN 'date' THEN strftime(date, '%d-%m-%Y') WHEN 'period' THEN strftime(start_date, '%d-%m-%Y') || ' a ' || strftime(end_date, '%d-%m-%Y') ELSE text END END AS shown,
        CASE status0 WHEN 'FOUND' THEN 'encontrado' WHEN 'NOT_FOUND' THEN 'não encontrado' ELSE 'ambíguo' END AS status_label FROM facts_v""",
    "file_slugs": r"""SELECT page_id, CASE WHEN slug = '' THEN 'apolice' ELSE slug END AS slug, CASE WHEN pp <> '' THEN pp END AS page_parameter FROM (
        SELECT page_id, lower(trim(regexp_replace(regexp_replace(name, '([^.])\.[^.]*$', '\1'), '[^0-9a-zA-Z]+', '_', 'g'), '_')) AS slug, pp
        FROM (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name, regexp_extract(url, '\?page=([0-9]*)', 1) AS pp FROM pages))""",
    "currency_conversion": f"""WITH {FACTS} SELECT policy_id, field_code, brl::DECIMAL(38,2)::VARCHAR AS amount_brl, brl IS NULL AS fx_error FROM (
        SELECT *, CASE WHEN currency = 'BRL' THEN amount ELSE round(amount * ({RATE.format(c='currency')})::DECIMAL(18,8), 2) END AS brl FROM facts_v) WHERE field_type = 'money' AND status0 = 'FOUND'""",
    "classify_pages": f"WITH {RESOLVED} SELECT document_id, page_number, source_type, used_ocr, coalesce(ocr_confidence < 0.5, FALSE) AS illegible, md5(text) AS text_md5 FROM resolved",
    "page_markdown": f"""WITH {PAGES} SELECT document_id, page_number, CASE WHEN laid_out THEN 'PP_STRUCTURE' WHEN NOT ({NATIVE_OK}) AND scanned THEN 'PADDLEOCR' ELSE 'NATIVE_TEXT' END AS source_type,
        md5(CASE WHEN laid_out THEN {strip("'## Artigo ' || doc_id || chr(10) || chr(10) || " + strip('body'))} WHEN NOT ({NATIVE_OK}) AND scanned THEN {strip('body')} ELSE {strip('native')} END) AS markdown_md5 FROM native_v""",
    "preview_text": f"""WITH {PAGES}, previews AS (SELECT document_id, CASE WHEN scanned THEN '[OCR/visão]' || chr(10) || {strip('body')} || chr(10) ELSE '' END || CASE WHEN {strip('native')} <> '' THEN '[texto nativo]' || chr(10) || {strip('native')} ELSE '' END AS t FROM native_v)
        SELECT document_id, count(*) AS pages, sum(length(t))::BIGINT AS chars, max(md5(t)) AS max_md5 FROM previews GROUP BY 1""",
    "ocr_confidence": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
        SELECT doc_id AS document_id, md5(coalesce(string_agg(t, chr(10) ORDER BY n) FILTER ({strip('t')} <> ''), '')) AS text_md5,
        round(avg(length(t) % 101 / 100.0::DOUBLE) FILTER ({strip('t')} <> ''), 10) AS ocr_confidence FROM l GROUP BY 1""",
    "compose_pages": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
        c AS (SELECT *, list_transform(string_split(t, '. '), lambda x: {strip('x')}) AS cells FROM l),
        r AS (SELECT doc_id, n, n % 5 AS m, {strip('t')} AS s, array_to_string(cells, ' | ') AS row_text, len(list_filter(cells, lambda x: x <> '')) > 0 AS filled FROM c)
        SELECT doc_id, md5(coalesce(string_agg(CASE WHEN m = 3 THEN '[TABELA]' || chr(10) || row_text ELSE s END, chr(10) ORDER BY n) FILTER (CASE WHEN m = 3 THEN filled ELSE s <> '' END), '')) AS text_md5,
        md5(coalesce(string_agg(CASE m WHEN 0 THEN '## ' || s WHEN 3 THEN '| ' || row_text || ' |' ELSE s END, chr(10) || chr(10) ORDER BY n) FILTER (CASE m WHEN 0 THEN TRUE WHEN 3 THEN filled ELSE s <> '' END), '')) AS markdown_md5
        FROM r GROUP BY 1""",
    "document_status": f"""WITH {RESOLVED}, d AS (SELECT document_id, bool_or(used_ocr) AS ocr, string_agg(page_number, ', ' ORDER BY page_number) FILTER (ocr_confidence < 0.5) AS bad FROM resolved GROUP BY 1)
        SELECT document_id, s.seq::INT AS seq, s.stage, s.label, s.progress::DOUBLE AS progress, CASE WHEN s.seq = 5 THEN 'REVIEW: páginas ilegíveis: ' || bad END AS message
        FROM d, (VALUES (1, 'RECEIVED', 'recebido', 0.0), (2, 'TEXT_EXTRACTED', 'texto extraído', 0.3), (3, 'OCR_COMPLETED', 'OCR concluído', 0.5), (4, 'INDEXED', 'indexado', 1.0), (5, 'REVIEW_REQUIRED', 'revisão necessária', 1.0)) s(seq, stage, label, progress)
        WHERE (s.seq <> 3 OR ocr) AND (s.seq <> 5 OR bad IS NOT NULL)""",
    "chunk_documents": f"""WITH {SINGLE} SELECT document_id || ':p1:c' || chunk_index AS chunk_id, policy_id, chunk_index::INT AS chunk_index, 'NATIVE_TEXT' AS source_type,
        sha256(text) AS content_fingerprint, length(text)::INT AS chars FROM pieces""",
    "assign_sections": f"WITH {CHUNKS} SELECT chunk_id, document_id, page_number, chunk_index::INT AS chunk_index, source_type, section_name, sha256(text) AS content_fingerprint FROM chunks_v",
    "ingested_chunks": f"WITH {CHUNKS} SELECT chunk_id, document_id, page_number, chunk_index::INT AS chunk_index, source_type, section_name, sha256(text) AS content_fingerprint FROM chunks_v",
    "fingerprint_audit": f"""WITH {SINGLE} SELECT document_id || ':p1:c2' AS chunk_id, document_id, sha256(document_id || ':p1:c2') AS content_fingerprint, sha256(text) AS recomputed_fingerprint
        FROM pieces WHERE chunk_index = 2""",
    "markdown_sections": f"WITH {SECTIONS} SELECT policy_id, page_number, section_index::INT AS section_index, title, md5(text) AS text_md5 FROM sections",
    "run_profile": f"""WITH {FACTS}, p AS (SELECT source AS policy_id, count(*) AS pages, sum(length(m)) AS chars, count(*) FILTER (contains(m, '|') AND contains(m, '---')) AS table_pages
          FROM (SELECT source, regexp_replace(text, '(?m)^([DEL])', '## \\1', 'g') AS m FROM documents) GROUP BY 1),
        s AS (SELECT 'src' || k % 20 AS policy_id, count(*) FILTER (status = 'FOUND') AS found, count(*) FILTER (status = 'NOT_FOUND') AS not_found, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review FROM facts_v GROUP BY 1)
        SELECT coalesce(p.policy_id, s.policy_id) AS policy_id, coalesce(pages, 0) AS pages, coalesce(chars, 0)::BIGINT AS chars, coalesce(table_pages, 0) AS table_pages,
        coalesce(found, 0) AS found, coalesce(not_found, 0) AS not_found, coalesce(needs_review, 0) AS needs_review FROM p FULL JOIN s USING (policy_id)""",
    "hashed_embedding": f"""WITH v AS (SELECT doc_id, {embed('text')} AS v FROM documents), n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
        SELECT doc_id, array_to_string(list_transform(v, lambda x: round(CASE WHEN n > 0 THEN x / n ELSE x END, 6)::DECIMAL(9,6)::VARCHAR), ',') AS vector FROM n""",
    "vector_topk": """WITH e AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT query_id, rank::INT AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT q.id AS query_id, c.id AS chunk_id, round(list_cosine_similarity(q.v, c.v), 6) + 0.0 AS score FROM e q, e c)) WHERE rank <= 5""",
    "vector_topk_wide": """WITH e AS (SELECT vec_id, vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v, label FROM embeddings)
        SELECT query_id, rank::INT AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT q.id AS query_id, q.vec_id % 51 AS k, c.id AS chunk_id, round(list_cosine_similarity(q.v, c.v), 6) + 0.0 AS score FROM e q JOIN e c ON q.vec_id % 2 = 0 OR q.label = c.label WHERE q.vec_id % 50 < 3)) WHERE rank <= k""",
    "retrieval_rejects": "SELECT conv_id || '.' || turn AS query_id, CASE WHEN coalesce(length(text), 0) < 1 THEN 'QUERY_EMPTY' ELSE 'TOP_K_OUT_OF_RANGE' END AS error_code FROM conversations WHERE coalesce(length(text), 0) < 1 OR NOT (turn * 9 BETWEEN 1 AND 20)",
    "vector_topk_filtered": """WITH e AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v, label FROM embeddings)
        SELECT query_id, rank::INT AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT q.id AS query_id, c.id AS chunk_id, round(list_cosine_similarity(q.v, c.v), 6) + 0.0 AS score FROM e q JOIN e c USING (label))) WHERE rank <= 3""",
    "retrieve_evidence": f"""WITH {VECTORS}, {QUESTIONS}, asked AS MATERIALIZED (SELECT query_id, {embed("query || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '[campo: franquia]' ELSE '' END")} AS v FROM questions), {search('asked', 5)}
        SELECT query_id, rank::INT AS rank, 'ev_' || chunk_id AS evidence_id, page_number, source_type, greatest(0.0, least(1.0, score)) AS retrieval_score FROM hits""",
    "breadth_evidence": f"""WITH {VECTORS}, topics AS (SELECT policy_id || '#' || ordinal AS query_id, policy_id, ordinal, query FROM (
          SELECT source AS policy_id, unnest(range(5)) AS ordinal, unnest(list_prepend(source, {listed(BREADTH_QUERIES)})) AS query FROM (SELECT DISTINCT source FROM documents))),
        asked AS MATERIALIZED (SELECT *, {embed('query')} AS v FROM topics), {search('asked', 20, 'q.policy_id = c.policy_id')},
        best AS (SELECT h.policy_id, 'ev_' || chunk_id AS evidence_id, ordinal, rank, greatest(0.0, least(1.0, score)) AS retrieval_score,
                 row_number() OVER (PARTITION BY h.policy_id, chunk_id ORDER BY ordinal, rank) AS n FROM hits h JOIN topics USING (query_id))
        SELECT policy_id, evidence_id, ordinal::INT AS query_ordinal, rank::INT AS rank, retrieval_score FROM best WHERE n = 1""",
    "question_evidence": f"""WITH {VECTORS}, {QUESTIONS}, asked AS MATERIALIZED (SELECT query_id, conv_id, 'src' || conv_id % 25 AS policy_id, {embed('query')} AS v FROM questions),
        {search('asked', 5, 'q.policy_id = c.policy_id')}, {READING.replace(SECTION_POLICY, 'source')},
        open_q AS (SELECT query_id, conv_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM hits)),
        filled AS (SELECT query_id, rank AS position, evidence_id FROM open_q JOIN reading ON conv_id % 2 = 0 AND policy_id = 'src' || conv_id % 3 WHERE rank <= 10)
        SELECT query_id, rank::INT AS position, 'ev_' || chunk_id AS evidence_id, 'search' AS origin FROM hits
        UNION ALL SELECT query_id, position::INT, evidence_id, 'fallback' FROM filled
        UNION ALL SELECT query_id, NULL::INT, NULL, 'notice' FROM open_q WHERE query_id NOT IN (SELECT query_id FROM filled)""",
    "section_ranking": f"WITH {RANKED} SELECT policy_id, field_code, rank::INT AS rank, evidence_id, title AS section_name, md5({QUOTED}) AS text_md5, retrieval_score FROM ranked",
    "reading_order": f"WITH {READING} SELECT policy_id, rank::INT AS rank, evidence_id, title AS section_name, md5({QUOTED}) AS text_md5 FROM reading",
    "evidence_rows": f"""WITH {RANKED}, flat AS (SELECT *, {strip("regexp_replace(text, '\\s+', ' ', 'g')")} AS t FROM (SELECT * REPLACE ({QUOTED} AS text) FROM ranked))
        SELECT evidence_id, field_code, policy_id AS policy_label, page_number::VARCHAR AS page, coalesce(nullif(title, ''), '—') AS section,
        CASE WHEN length(t) <= 160 THEN t ELSE rtrim(substr(t, 1, 160)) || '…' END AS excerpt, 'estrutura de layout' AS origin FROM flat""",
    "section_feed": f"""WITH {READING} SELECT policy_id, evidence_id, 'doc ' || policy_id || ' · pág. ' || page_number || CASE WHEN coalesce(title, '') <> '' THEN ' · seção ' || title ELSE '' END AS source, md5({QUOTED}) AS text_md5 FROM reading""",
    "markdown_feed": f"""WITH {SECTIONS} SELECT policy_id, position, coalesce(nullif(title, ''), 'seção ' || position) || ' · pág. ' || page_number AS source, md5(text) AS text_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY page_number, section_index) AS position FROM sections)""",
    "parse_responses": """WITH d AS (SELECT doc_id, doc_id % 10 AS m FROM documents)
        SELECT doc_id::VARCHAR AS policy_id, f.field_code, f.pos::INT AS position, NULL::VARCHAR AS error_code
        FROM d, (VALUES (0, 'limite_agregado'), (1, 'prazo_notificacao_sinistro'), (2, 'exclusoes_chave')) f(pos, field_code) WHERE m NOT IN (7, 8)
        UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, 'LLM_SCHEMA_INVALID' FROM d WHERE m IN (7, 8)""",
    "complete_prompts": """SELECT d.doc_id, substr(sha256(d.text), 1, 12) AS prompt_hash, CASE WHEN l.doc_id IS NOT NULL THEN '{"quality":' || quality || ',"toxic":' || toxic || '}' END AS payload,
        l.doc_id IS NOT NULL AS answered FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "catalog_guard": f"""SELECT field_code, error_code, count(*) AS n FROM (
        SELECT CASE WHEN event_id % 2 = 0 THEN f.field_code ELSE event_type END AS field_code, CASE WHEN event_id % 2 <> 0 THEN 'UNKNOWN_FIELD_CODE' END AS error_code
        FROM events, {FIELDS} WHERE f.ordinal = event_id % 10 + 1) GROUP BY 1, 2""",
    "validate_facts": f"WITH {FACTS} SELECT policy_id, field_code, status, review AS requires_human_review, array_to_string(rules, ',') AS rules FROM facts_v",
    "build_facts": f"""WITH {BUILT} SELECT 'FAC-' || doc_id || '-' || field_code AS fact_id, doc_id::VARCHAR AS policy_id, field_code, CASE WHEN bad > 0 OR zero THEN 'NEEDS_REVIEW' ELSE 'FOUND' END AS status,
        bad > 0 OR zero AS requires_human_review, bad::INT AS anchor_violations,
        md5(CASE pos WHEN 0 THEN 'amount=' || n_chars || '.00, currency=BRL' WHEN 1 THEN 'number=' || n_chars ELSE 'text=' || {fold("'diz “' || quote || '” e mais'")} END) AS value_md5
        FROM (SELECT *, pos < 2 AND n_chars = 0 AS zero FROM anchored) WHERE doc_id NOT IN (SELECT doc_id FROM bad_docs)""",
    "evidence_guard": f"WITH {BUILT} SELECT doc_id::VARCHAR AS policy_id, field_code, error_code FROM bad_docs",
    "persisted_facts": f"WITH {FACTS} SELECT fact_id, status, CASE WHEN review THEN 'PENDENTE' ELSE 'CONFIRMADO' END AS revisao_status, 'run1' AS run_id, '1.0' AS schema_version FROM facts_v",
    "extra_findings": """WITH x AS (SELECT doc_id, unnest([0, 1, 2]) AS i, lang, source, n_chars FROM documents),
        kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM x WHERE i = 0 OR (i = 1 AND doc_id % 2 <> 0) OR (i = 2 AND doc_id % 3 <> 0))
        SELECT 'EXF-' || doc_id || '-' || lpad(n::VARCHAR, 3, '0') AS finding_id, doc_id::VARCHAR AS policy_id, ['Idioma', 'Fonte', 'Tamanho'][i + 1] AS label,
        [lang, source, n_chars::VARCHAR][i + 1] AS value, CASE WHEN i = 2 THEN 'caracteres' END AS detail, 'ev' || doc_id AS evidence_ids FROM kept""",
    "finding_scan": """WITH x AS (SELECT doc_id, unnest([0, 1, 2]) AS i, lang, source, n_chars FROM documents),
        kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM x WHERE i = 0 OR (i = 1 AND doc_id % 2 <> 0) OR (i = 2 AND doc_id % 3 <> 0))
        SELECT 'EXF-' || doc_id || '-' || lpad(n::VARCHAR, 3, '0') AS finding_id, doc_id::VARCHAR AS policy_id, ['Idioma', 'Fonte', 'Tamanho'][i + 1] AS label,
        [lang, source, n_chars::VARCHAR][i + 1] AS value, CASE WHEN i = 2 THEN 'caracteres' END AS detail, 'ev' || doc_id AS evidence_ids FROM kept WHERE doc_id = 10""",
    "compare_policies": f"""WITH {COMPARED} SELECT a::VARCHAR AS policy_id_a, b::VARCHAR AS policy_id_b, ordinal::INT AS ordinal, field_code, resultado, {DIRECTION} AS direcao,
        NULL::VARCHAR AS error_code, valor_a, valor_b, coalesce(ev_a, '') AS evidencias_a, coalesce(ev_b, '') AS evidencias_b FROM grid_v""",
    "compare_policies_missing_rate": f"""WITH {FACTS}, {PAIRS}, plain AS (SELECT * EXCLUDE (flagged), FALSE AS flagged FROM facts_v),
        {grid('status0', 'flagged', "CASE {c} WHEN 'USD' THEN '5.25' END").replace('facts_v', 'plain')}
        SELECT a::VARCHAR AS policy_id_a, b::VARCHAR AS policy_id_b, field_code, resultado, {DIRECTION} AS direcao, CASE WHEN resultado IS NULL THEN 'FX_RATE_MISSING' END AS error_code FROM grid_v""",
    "comparison_ids": f"""WITH {PAIRS} SELECT a::VARCHAR AS policy_id_a, b::VARCHAR AS policy_id_b, {COMPARISON_ID} AS comparison_id, {uuid5("'comparison:' || b || '|' || a")} AS reverse_id FROM pairs_v""",
    "comparison_differences": f"WITH {COMPARED} SELECT field_code, resultado, count(*) AS n FROM grid_v WHERE resultado NOT IN ('IGUAL', 'AUSENTES_AMBOS') GROUP BY 1, 2",
    "comparison_markdown": f"""WITH {COMPARED}, parts AS (SELECT a, b, ordinal, '## ' || label || ' (`' || g.field_code || '`)' || repeat(chr(10), 2) || '- **Resultado:** ' || resultado || ' (direção: ' || {DIRECTION} || ')' || chr(10)
          || '- **Valor A:** ' || coalesce(valor_a, 'ausente') || chr(10) || '- **Valor B:** ' || coalesce(valor_b, 'ausente') || chr(10) || '- **Evidências A:** ' || coalesce(ev_a, '—') || chr(10)
          || '- **Evidências B:** ' || coalesce(ev_b, '—') || chr(10) || '- **Explicação:** pendente' || chr(10) AS part FROM grid_v g JOIN (SELECT field_code, label FROM {FIELDS}) USING (field_code)),
        ids AS (SELECT a, b, {COMPARISON_ID} AS cid FROM pairs_v)
        SELECT cid AS comparison_id, md5('# Comparação de Apólices D&O — Resumo da Análise' || repeat(chr(10), 2) || '- **ComparisonId:** `' || cid || '`' || chr(10) || '- **Apólice A:** ' || a || chr(10) || '- **Apólice B:** ' || b
          || repeat(chr(10), 2) || string_agg(part, chr(10) ORDER BY ordinal)) AS markdown_md5 FROM parts JOIN ids USING (a, b) GROUP BY cid, a, b""",
    "explanations": f"""WITH {COMPARED}, x AS (SELECT *, (a + ordinal) % 5 AS m FROM grid_v)
        SELECT a::VARCHAR AS policy_id_a, field_code, CASE WHEN ordinal IN (9, 10) THEN NULL
          WHEN m = 0 THEN 'Comparação de ' || field_code || ': ' || resultado || '. Direção: ' || {DIRECTION} || '. Evidências citadas: ' || coalesce(nullif(concat_ws(', ', ev_a, ev_b), ''), 'nenhuma') || '.'
          WHEN m = 1 AND (ev_a IS NOT NULL OR ev_b IS NOT NULL) THEN 'texto ' || a
          WHEN m = 2 AND ev_a IS NOT NULL AND ev_b IS NULL THEN 'texto ' || a WHEN m = 4 AND ev_b IS NOT NULL AND ev_a IS NULL THEN 'texto ' || a END AS explicacao FROM x""",
    "explanation_rejects": f"""WITH {COMPARED}, x AS (SELECT *, (a + ordinal) % 5 AS m FROM grid_v)
        SELECT field_code, error_code, count(*) AS n FROM (
          SELECT CASE WHEN ordinal = 9 THEN 'outro_campo' ELSE field_code END AS field_code,
            CASE WHEN ordinal = 9 THEN 'COMPARISON_FIELD_NOT_FOUND' WHEN ordinal = 10 THEN 'COMPARISON_NOT_FOUND'
              WHEN m = 0 OR (m = 1 AND (ev_a IS NOT NULL OR ev_b IS NOT NULL)) OR (m = 2 AND ev_a IS NOT NULL AND ev_b IS NULL) OR (m = 4 AND ev_b IS NOT NULL AND ev_a IS NULL) THEN NULL
              ELSE 'EXPLANATION_NOT_CITED' END AS error_code FROM x) WHERE error_code IS NOT NULL GROUP BY 1, 2""",
    "review_queue": f"WITH {FACTS} SELECT fact_id, policy_id, field_code, status FROM facts_v WHERE review",
    "apply_reviews": f"""WITH {FACTS}, {DECISIONS} SELECT f.fact_id, CASE WHEN m.resolved THEN 'FOUND' ELSE f.status END AS status, CASE WHEN m.fact_id IS NOT NULL THEN m.decision = 'DIVERGENTE' ELSE f.review END AS requires_human_review,
        CASE WHEN m.fact_id IS NOT NULL THEN m.decision WHEN f.review THEN 'PENDENTE' ELSE 'CONFIRMADO' END AS revisao_status, m.decided_by AS revisao_por, coalesce(m.corrected, f.value) AS value,
        strftime(m.ts, '%Y-%m-%d %H:%M:%S') AS revisao_em FROM facts_v f LEFT JOIN merged m USING (fact_id)""",
    "review_rejects": f"""WITH {FACTS}, {DECISIONS} SELECT fact_id, seq, decision, reason, CASE WHEN reason = 'RULE_VIOLATION' THEN CASE WHEN field_type = 'money' AND currency = 'XXX' THEN 'moeda_conhecida' ELSE 'valor_positivo' END END AS rules
        FROM judged WHERE reason IS NOT NULL""",
    "decision_history": f"WITH {FACTS}, {DECISIONS} SELECT fact_id, decision AS revisao_status, decided_by AS revisao_por, decision AS decisao, nullif(note, '') AS nota FROM merged",
    "bulk_feedback": f"""WITH {FACTS}, {DECISIONS.replace("ELSE 'OUTRO'", "ELSE 'DIVERGENTE'")} SELECT fact_id, seq, CASE WHEN reason IS NULL THEN decision END AS decision,
        CASE reason WHEN 'VALUE_REQUIRED' THEN 'ValueError' WHEN 'NORMALIZATION_ERROR' THEN 'NormalizationError' WHEN 'RULE_VIOLATION' THEN 'ContractValidationError' ELSE reason END AS reason FROM judged""",
    "recompared": f"""WITH {FACTS}, {PAIRS}, after_v AS (SELECT * EXCLUDE (review), CASE WHEN k % 10 = 3 THEN status <> 'FOUND' ELSE review END AS review FROM facts_v),
        {grid('status', 'review', RATE).replace('facts_v', 'after_v')}
        SELECT a::VARCHAR AS policy_id_a, b::VARCHAR AS policy_id_b, ordinal::INT AS ordinal, field_code, resultado, {DIRECTION} AS direcao, CASE WHEN ordinal % 2 = 0 THEN 'nota ' || field_code END AS explicacao FROM grid_v""",
    "recompare_pairs": f"WITH {PAIRS} SELECT a::VARCHAR AS policy_id_a, b::VARCHAR AS policy_id_b FROM pairs_v WHERE a IN (SELECT user_id FROM events) OR b IN (SELECT user_id FROM events)",
    "issues": f"WITH {ISSUES}, {FAILURES} SELECT policy_id, field_code, severity, severity_rank::INT AS severity_rank, reason FROM (SELECT * FROM issues_v UNION ALL SELECT * FROM failures_v)",
    "issue_counts": f"WITH {ISSUES}, {FAILURES} SELECT policy_id, {COUNTS} FROM (SELECT * FROM issues_v UNION ALL SELECT * FROM failures_v) GROUP BY 1",
    "comparison_issue_counts": f"""WITH {ISSUES}, {PAIRS} SELECT a::VARCHAR AS policy_id_a, b::VARCHAR AS policy_id_b, {COUNTS} FROM pairs_v LEFT JOIN issues_v ON policy_id IN (a::VARCHAR, b::VARCHAR) GROUP BY 1, 2""",
    "first_evidence": f"""WITH {ISSUES} SELECT policy_id, field_code, severity, reason, CASE WHEN policy_id::BIGINT IN (SELECT doc_id FROM documents) THEN 'ev' || policy_id END AS first_evidence_id FROM issues_v""",
    "severity_groups": f"""WITH {ISSUES} SELECT fact_id, ['CRÍTICO', 'ALTO', 'MÉDIO', 'BAIXO'][r] AS severity, r::INT AS severity_rank FROM (
        SELECT fact_id, coalesce(min(severity_rank), 4) AS r FROM facts_v LEFT JOIN issues_v USING (policy_id, field_code) GROUP BY 1)""",
    "usage_cost": f"WITH {USAGE} SELECT seq, ['gemini-2.0-flash', 'xiaomi/mimo-v2.6-pro', 'outro'][m + 1] AS model_name, cost_usd FROM cost_v",
    "usage_summary": f"""WITH {USAGE} SELECT run_id, arg_min(kind, seq) AS kind, count(*) AS calls, sum(tin)::BIGINT AS request_tokens, sum(tout)::BIGINT AS response_tokens, sum(latency)::BIGINT AS latency_ms,
        sum(cost_usd::DECIMAL(28,6))::DOUBLE AS cost_usd, '{PRICE_REFERENCE_DATE}' AS price_reference_date FROM cost_v GROUP BY 1""",
    "usage_panel": f"""WITH {USAGE} SELECT run_id::VARCHAR AS run_id, count(*)::VARCHAR AS calls, sum(tin)::VARCHAR AS tokens_in, sum(tout)::VARCHAR AS tokens_out, sum(latency) || ' ms' AS latency,
        coalesce('US$ ' || sum(cost_usd::DECIMAL(28,6)), 'n/d (modelo fora da tabela de preços)') AS cost, '{PRICE_REFERENCE_DATE}' AS price_reference FROM cost_v GROUP BY events_run(run_id)""".replace("events_run(run_id)", "run_id"),
    "last_run": "SELECT arg_max(user_id, f) AS run_id FROM (SELECT user_id, min(event_id) AS f FROM events GROUP BY 1)",
    "embedding_usage": "SELECT source AS run_id, floor(doc_id / 100)::BIGINT AS batch, count(*) AS texts, sum(n_chars)::BIGINT AS request_tokens, sum(length(text))::BIGINT AS latency_ms, 'EMBED' AS kind FROM documents GROUP BY 1, 2",
    "status_current": """SELECT 'doc' || user_id AS document_id, max(event_id) AS seq, arg_max(s.stage, event_id) AS stage, arg_max(s.progress, event_id)::DOUBLE AS progress,
        CASE WHEN arg_max(s.stage, event_id) = 'FAILED' THEN 'OCR: erro' END AS message
        FROM events JOIN (VALUES ('click', 'RECEIVED', 0.0), ('view', 'TEXT_EXTRACTED', 0.3), ('signup', 'OCR_COMPLETED', 0.5), ('purchase', 'INDEXED', 1.0), ('error', 'FAILED', 0.0)) s(event_type, stage, progress) USING (event_type) GROUP BY user_id""",
    "failure_status": """SELECT doc_id::VARCHAR AS document_id, 'FAILED' AS stage, 0.0::DOUBLE AS progress, 'EVIDENCE_UNKNOWN: evidência desconhecida em ' || f.field_code || ' (reexecutável=' || CASE WHEN f.pos = 0 THEN 'True' ELSE 'False' END || ')' AS message
        FROM documents, (VALUES (0, 'limite_agregado'), (1, 'prazo_notificacao_sinistro'), (2, 'exclusoes_chave')) f(pos, field_code)""",
    "insurer_candidates": f"WITH {COVERS} SELECT policy_id, 1::INT AS page_number, line_number::INT AS line_number, name, year FROM read_names",
    "insurer_detection": f"WITH {COVERS} SELECT policy_id, name, year FROM detected",
    "insurer_escalation": f"""WITH {COVERS} SELECT c.policy_id, CASE WHEN d.k IS NOT NULL THEN d.name WHEN c.k % 4 = 2 THEN c.c_name WHEN c.k % 8 <> 0 THEN 'Digitada ' || c.seg END AS name,
        CASE WHEN d.k IS NOT NULL THEN d.year WHEN c.k % 4 = 2 THEN '2020' END AS year FROM covers c LEFT JOIN detected d USING (k)""",
    "display_labels": f"""WITH {COVERS}, n AS (SELECT *, CASE WHEN k % 9 <> 0 THEN seg END AS name, coalesce(strftime(last, '%Y-%m'), '') AS y FROM covers),
        g AS (SELECT scope, name, count(*) AS n, count(DISTINCT y) = count(*) AND bool_and(y <> '') AS by_year FROM n WHERE name IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT n.*, g.n AS size, g.by_year, row_number() OVER (PARTITION BY n.scope, n.name ORDER BY k) AS place FROM n LEFT JOIN g ON g.scope = n.scope AND g.name = n.name)
        SELECT scope, policy_id, CASE WHEN name IS NULL THEN policy_id WHEN size = 1 THEN name WHEN by_year THEN name || ' ' || y ELSE name || ' ' || CASE WHEN place > 702 THEN chr((65 + (place - 703) // 676 % 26)::INT) ELSE '' END || CASE WHEN place > 26 THEN chr((65 + (place - 27) // 26 % 26)::INT) ELSE '' END || chr((65 + (place - 1) % 26)::INT) END AS label FROM p""",
    "report_checklist": f"""WITH {CELLS}, m AS (SELECT *, status <> 'Não localizado' AS filled FROM cells),
        per_code AS (SELECT s_nationkey AS n, field_code, count(*) FILTER (filled) AS c FROM m GROUP BY 1, 2),
        r AS (SELECT s_nationkey AS n, count(DISTINCT k) AS policies, count(*) FILTER (category = 'coberturas_extensoes' AND status = 'Previsto' AND referencia IS NULL) = 0 AS extensions,
              count(*) FILTER (category = 'custos_defesa' AND filled) > 0 AS defense, count(*) FILTER (category = 'exclusoes' AND exclusoes_condicoes IS NOT NULL) > 0 AS conditions,
              count(*) FILTER (NOT filled AND origem <> 'nao_localizado') = 0 AS gaps, bool_and(k % 5 < 3) AS companies FROM m GROUP BY 1),
        c AS (SELECT r.*, (SELECT bool_and(c > 0) FROM per_code p WHERE p.n = r.n AND field_code IN ('lmg', 'lmi', 'limite_agregado', 'sublimites')) AS limits,
              (SELECT bool_and(c >= least(2, r.policies)) FROM per_code p WHERE p.n = r.n AND field_code IN ('base_ocorrencia_claims_made', 'notificacao_quem_prazo_forma')) AS notices,
              (SELECT bool_and(c > 0) FROM per_code p WHERE p.n = r.n AND field_code IN ('protecao_direta_administrador_ab_side', 'protecao_sociedade_c_side')) AS sides FROM r)
        SELECT 'r' || n AS report_id, i.item_order::INT AS item_order, i.item,
          [n % 2 = 0, n % 3 = 0, extensions, limits, defense, notices, conditions, sides, companies, n % 4 = 0, n % 4 = 0 OR n % 3 = 0, gaps, n % 5 = 0, n % 6 = 0][i.item_order] AS ok
        FROM c, (VALUES {", ".join(f"({i}, {lit(item)})" for i, (_, item) in enumerate(CHECKLIST, start=1))}) i(item_order, item)""",
    "extraction_prompts": f"""WITH {READING}, e AS (SELECT policy_id, string_agg({EVIDENCE_LINE}, chr(10) ORDER BY rank) AS lines FROM reading GROUP BY 1),
        p AS (SELECT policy_id, {lit(EXTRACTION_HEAD)} || {" || repeat(chr(10), 2) || ".join(f"'## Campo: {row[0]} (schema_version=1.0)' || chr(10) || lines" for row in FIELD_TABLE)} AS prompt FROM e)
        SELECT policy_id, '1' AS prompt_version, substr(sha256(prompt), 1, 12) AS prompt_hash, length(prompt)::INT AS prompt_chars FROM p""",
    "findings_prompts": f"""WITH {READING}, p AS (SELECT policy_id, {lit(FINDINGS_HEAD)} || string_agg({EVIDENCE_LINE}, chr(10) ORDER BY rank) AS prompt FROM reading GROUP BY 1)
        SELECT policy_id, substr(sha256(prompt), 1, 12) AS prompt_hash, length(prompt)::INT AS prompt_chars FROM p""",
    "explanation_prompts": f"""WITH {COMPARED}, ids AS (SELECT a, b, {COMPARISON_ID} AS comparison_id FROM pairs_v),
        p AS (SELECT comparison_id, field_code, {lit(EXPLANATION_HEAD)} || 'Campo: ' || field_code || ' | resultado: ' || resultado || chr(10) || 'Lado A: ' || coalesce(valor_a, 'ausente') || ' | evidências: ' || coalesce(ev_a, '')
          || chr(10) || 'Lado B: ' || coalesce(valor_b, 'ausente') || ' | evidências: ' || coalesce(ev_b, '') AS prompt FROM grid_v JOIN ids USING (a, b) WHERE resultado NOT IN ('IGUAL', 'AUSENTES_AMBOS'))
        SELECT comparison_id, field_code, substr(sha256(prompt), 1, 12) AS prompt_hash, length(prompt)::INT AS prompt_chars FROM p""",
    "question_prompts": f"""WITH {VECTORS}, {QUESTIONS}, asked AS MATERIALIZED (SELECT query_id, {embed('query')} AS v FROM questions), {search('asked', 5)},
        e AS (SELECT query_id, string_agg('- [ev_' || chunk_id || '] pág. ' || page_number || CASE WHEN coalesce(section_name, '') <> '' THEN ' seção ' || section_name ELSE '' END || ': "' || quoted_text || '"', chr(10) ORDER BY rank) AS lines FROM hits GROUP BY 1),
        p AS (SELECT query_id, {lit(QUESTION_HEAD)} || {strip('query')} || repeat(chr(10), 2) || '## Evidências' || chr(10) || lines AS prompt FROM questions JOIN e USING (query_id))
        SELECT query_id, substr(sha256(prompt), 1, 12) AS prompt_hash, length(prompt)::INT AS prompt_chars FROM p""",
    "report_matrix": f"""WITH {CELLS} SELECT k::VARCHAR AS policy_id, ordinal::INT AS ordinal, field_code, category, status, limite_franquia, exclusoes_condicoes, NULL::VARCHAR AS impacto_pratico, NULL::VARCHAR AS impacto_financeiro, referencia, origem FROM cells""",
    "report_matrix_rejects": f"""WITH lmg AS (SELECT ordinal FROM {REPORT_FIELDS} WHERE field_code = 'lmg'), s AS (SELECT s_suppkey AS k, s_suppkey % 13 = 0 AND (s_suppkey + ordinal) % 4 <> 1 AS bad FROM supplier, lmg)
        SELECT k::VARCHAR AS policy_id, 90::BIGINT AS cells, NULL::VARCHAR AS error_code FROM s WHERE NOT bad UNION ALL SELECT k::VARCHAR, 0::BIGINT, 'LLM_SCHEMA_INVALID' FROM s WHERE bad""",
    "report_identification": """SELECT s_suppkey::VARCHAR AS policy_id, s_name AS seguradora, NULL::VARCHAR AS produto, CASE s_suppkey % 5 WHEN 0 THEN 'aberta' WHEN 1 THEN 'fechada' WHEN 2 THEN 'ambas' END AS empresa_aberta_fechada,
        CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::INT END AS num_paginas, s_name || ',D&O' AS secoes_natureza, 0::INT AS limitacoes, CASE WHEN s_suppkey % 3 = 0 THEN 'anexo' END AS ausentes FROM supplier""",
    "report_tables": f"""WITH r AS (SELECT s_nationkey AS n, s_suppkey::VARCHAR AS p FROM supplier)
        SELECT 'r' || n AS report_id, p AS policy_id, CASE WHEN p = n::VARCHAR THEN 'célula ' || n END AS value, 'table' AS kind FROM r
        UNION ALL SELECT 'r' || n, p, CASE WHEN p = n::VARCHAR THEN ' célula ' || n ELSE '' END, 'scenario' FROM r""",
    "report_conclusions": f"""SELECT 'r' || n AS report_id, c.i::INT AS key_order, c.key, c.title, CASE WHEN c.key = '5_riscos' THEN '["' || n || '"]' WHEN c.key = 'vantagens' AND n % 2 = 0 THEN '{{"' || n || '":"a"}}' ELSE '[]' END AS value_json
        FROM ({SMALL_NATION}), (VALUES {", ".join(f"({i}, {lit(k)}, {lit(t)})" for i, (k, t) in enumerate(CONCLUSION_TITLES, start=1))}) c(i, key, title)""",
    "normalize_weights": "SELECT p_brand AS scenario, p_type AS criterion, round(sum(p_size)::DOUBLE * 100.0 / sum(sum(p_size)::DOUBLE) OVER (PARTITION BY p_brand), 6) AS weight FROM part GROUP BY 1, 2",
    "ranking_by_report": f"""WITH t AS (SELECT s_nationkey, s_suppkey, {TOTAL} AS total FROM supplier, {WEIGHTS} GROUP BY 1, 2)
        SELECT s_nationkey AS report_key, s_suppkey::VARCHAR AS policy_id, total::VARCHAR AS total, row_number() OVER (PARTITION BY s_nationkey ORDER BY total DESC, s_suppkey) AS rank FROM t""",
    "ranking_all": f"""WITH t AS (SELECT s_suppkey, {TOTAL} AS total FROM supplier, {WEIGHTS} GROUP BY 1)
        SELECT s_suppkey::VARCHAR AS policy_id, total::VARCHAR AS total, row_number() OVER (ORDER BY total DESC, s_suppkey) AS rank FROM t""",
    "sensitivity": f"""WITH t AS (SELECT scenario, s_nationkey, s_suppkey, {TOTAL} AS total FROM supplier, {SCENARIOS} GROUP BY 1, 2, 3)
        SELECT scenario, s_nationkey AS report_key, s_suppkey::VARCHAR AS policy_id, total::VARCHAR AS total, row_number() OVER (PARTITION BY scenario, s_nationkey ORDER BY total DESC, s_suppkey) AS rank FROM t""",
    "ranking_rejects": """SELECT 'base' AS scenario, s_suppkey::VARCHAR AS policy_id, CASE WHEN s_suppkey % 10 = 0 THEN 'NOTE_OUT_OF_RANGE' ELSE 'CRITERION_WITHOUT_NOTE' END AS error_code FROM supplier WHERE s_suppkey % 10 IN (0, 1)""",
    "ranking_wide": f"""SELECT 'base' AS scenario, s_suppkey::VARCHAR AS policy_id, {TOTAL}::VARCHAR AS total, {", ".join(f"max({NOTE}::DOUBLE) FILTER (ordinal = {i}) AS {c}" for i, c in enumerate(CRITERION_CODES, start=1))} FROM supplier, {WEIGHTS} GROUP BY s_suppkey""",
    "winner_guard": f"""WITH g AS (SELECT s_suppkey AS k, array_to_string(list_filter([{", ".join(f"CASE WHEN s_suppkey % {i + 2} = 0{' OR s_suppkey % 5 = 0' if code == 'perfil_do_contratante' else ''} THEN {lit(label)} END" for i, (code, label) in enumerate(GUARD_FACTS))}], lambda x: x IS NOT NULL), ', ') AS missing FROM supplier)
        SELECT k::VARCHAR AS policy_id, missing <> '' AS informative_only, CASE WHEN missing <> '' THEN 'Sem vencedora geral: o ranking é informativo porque faltam dados de ' || missing || ' (§9 — não há conclusão financeira sem dados financeiros).' END AS reason FROM g""",
    "report_ids": f"""WITH l AS (SELECT l_orderkey, string_agg(l_partkey, '|' ORDER BY l_linenumber, l_partkey) AS n FROM lineitem GROUP BY 1)
        SELECT l_orderkey, {uuid5("'report:' || n")} AS report_id, CASE WHEN l_orderkey % 2 = 0 THEN 'com_documentos_perfil' ELSE 'comparacao_documental' END AS profile_mode FROM l""",
    "evaluation_entries": f"""WITH {EVALUATED} SELECT 'caso' || doc_id AS case_id, 'prazo_notificacao_sinistro' AS field_code, expected_status, extracted_status, result,
        CASE result WHEN 'nao_avaliado' THEN 'campo não avaliado' WHEN 'ausente' THEN 'campo não encontrado na apólice' WHEN 'inconclusivo' THEN 'extração sinalizada para revisão humana (EC-03)'
          WHEN 'divergente' THEN CASE WHEN expected_status = 'NOT_FOUND' THEN 'campo extraído mas não esperado na referência' ELSE 'valor divergente do esperado' END END AS detail, evidence_ok FROM results""",
    "evaluation_json": f"""WITH {EVALUATED} SELECT 'caso' || doc_id AS case_id, 'prazo_notificacao_sinistro' AS field_code, expected_status, extracted_status, result,
        CASE result WHEN 'nao_avaliado' THEN 'campo não avaliado' WHEN 'ausente' THEN 'campo não encontrado na apólice' WHEN 'inconclusivo' THEN 'extração sinalizada para revisão humana (EC-03)'
          WHEN 'divergente' THEN CASE WHEN expected_status = 'NOT_FOUND' THEN 'campo extraído mas não esperado na referência' ELSE 'valor divergente do esperado' END END AS detail, evidence_ok FROM results""",
    "evaluation_totals": f"""WITH {EVALUATED} SELECT count(*) AS total_cases, count(*) FILTER (result = 'correto') AS correct, count(*) FILTER (result = 'divergente') AS divergent, count(*) FILTER (result = 'ausente') AS absent,
        count(*) FILTER (result = 'inconclusivo') AS inconclusive, count(*) FILTER (result = 'nao_avaliado') AS not_evaluated, count(*) FILTER (evidence_ok) AS evidence_correct FROM results""",
    "reference_violations": """SELECT DISTINCT case_id, field_code, violation FROM (
        SELECT 'caso' || doc_id AS case_id, 'prazo_notificacao_sinistro' AS field_code, unnest([CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'FOUND_WITHOUT_VALUE' ELSE 'NOT_FOUND_WITH_VALUE' END END, CASE WHEN doc_id % 9 = 0 THEN 'FIELD_CODE_REPEATED' END]) AS violation
        FROM labels JOIN documents USING (doc_id)) WHERE violation IS NOT NULL""",
    "evidence_violations": """SELECT * FROM (SELECT doc_id AS evidence_id, CASE WHEN doc_id % 5 < 1 THEN 'PAGE_NUMBER' WHEN doc_id % 7 = 0 OR text = '' THEN 'QUOTED_TEXT' WHEN doc_id % 12 > 10 THEN 'RETRIEVAL_SCORE'
        WHEN doc_id % 3 = 0 THEN 'OCR_CONFIDENCE' WHEN doc_id % 11 = 0 THEN 'SOURCE_TYPE' END AS violation FROM documents) WHERE violation IS NOT NULL""",
    "document_intake": """WITH f AS (SELECT 'arquivo' || page_id || CASE WHEN page_id % 6 = 3 THEN '.PDF' WHEN page_id % 15 = 0 THEN '.txt' ELSE '.pdf' END AS path, page_id,
          strlen(CASE page_id % 3 WHEN 0 THEN '%PDF-1.7' || chr(10) WHEN 1 THEN '%PDF' ELSE '' END || html) AS length, page_id % 3 = 0 OR (page_id % 3 = 1 AND starts_with(html, '-')) OR starts_with(html, '%PDF-') AS signed FROM pages),
        g AS (SELECT path, length, signed AND lower(path) LIKE '%.pdf' AND length <= 8000 AS accepted FROM f)
        SELECT path, length, coalesce(accepted, FALSE) AS accepted, CASE WHEN accepted THEN 'RECEIVED' ELSE 'FAILED' END AS stage, CASE WHEN accepted THEN NULL ELSE 'EXTRACT: arquivo inválido' END AS message FROM g""",
    "page_scan": f"WITH {PAGES} SELECT page_number, md5(native) AS text_md5 FROM native_v WHERE document_id = 'src3'",
    "markdown_scan": "SELECT 'pol' || (doc_id // 8) AS policy_id, doc_id + 1 AS page_number, md5(regexp_replace(text, '(?m)^([DEL])', '## \\1', 'g')) AS markdown_md5 FROM documents WHERE doc_id // 8 = 3",
    "bundle_evidence": """SELECT 'pol' || (doc_id // 8) AS policy_id, 'ev' || doc_id AS evidence_id, doc_id::VARCHAR AS document_id, (doc_id % 8 + 1)::INT AS page_number, md5(text) AS text_md5,
        n_chars % 11 / 10.0::DOUBLE AS retrieval_score, n_chars::VARCHAR AS value, 0.5::DOUBLE AS confidence FROM documents WHERE doc_id // 8 % 10 <> 7""",
    "bundle_rejects": """WITH p AS (SELECT DISTINCT doc_id // 8 AS k FROM documents) SELECT CASE WHEN k % 10 = 7 THEN 'JSON_INVALID' ELSE 'READ' END AS error_code, count(*) AS n FROM p GROUP BY 1""",
    "reference_set_load": f"""WITH e AS (SELECT 'caso' || doc_id AS case_id, 'prazo_notificacao_sinistro' AS field_code, CASE WHEN quality = 1 THEN 'FOUND' ELSE 'NOT_FOUND' END AS status,
          CASE WHEN quality = 1 THEN '{{"number":"' || n_chars || '"}}' END AS expected_value, CASE WHEN quality = 1 THEN md5({LAST_LINE}) END AS quote_md5 FROM labels JOIN documents d USING (doc_id))
        SELECT case_id, field_code, status, expected_value, quote_md5 FROM e""",
    "missing_vectors": "SELECT vec_id::VARCHAR AS chunk_id, CASE WHEN vec_id % 9 = 0 THEN 'VECTOR_MISSING' ELSE 'OK' END AS error_code FROM embeddings",
    "external_embedding": "SELECT doc_id, length(coalesce(text, '')) AS chars, length(text) - length(replace(text, ' ', '')) AS blanks, 1::BIGINT AS in_batch FROM documents",
    "evaluation_run_id": f"""WITH e AS (SELECT doc_id, n_chars, quality, {LAST_LINE} AS quote FROM labels JOIN documents d USING (doc_id)),
        h AS (SELECT sha256(CASE WHEN quality = 1 THEN to_json({{'case_id': 'caso' || doc_id, 'policy_id': doc_id::VARCHAR, 'field_code': 'prazo_notificacao_sinistro', 'status': 'FOUND', 'expected_value': '{{"number":"' || n_chars || '"}}', 'evidence_quote': quote}})::VARCHAR
            ELSE to_json({{'case_id': 'caso' || doc_id, 'policy_id': doc_id::VARCHAR, 'field_code': 'prazo_notificacao_sinistro', 'status': 'NOT_FOUND'}})::VARCHAR END) AS x FROM e),
        t AS (SELECT count(*)::VARCHAR AS n, {", ".join(f"sum(('0x' || substr(x, {1 + 15 * i}, 15))::BIGINT::HUGEINT)::VARCHAR AS w{i}" for i in range(4))} FROM h)
        SELECT 'eval_' || substr(sha256(concat_ws('|', n, w0, w1, w2, w3)), 1, 12) AS run_id FROM t""",
    "identification_prompts": f"""WITH {READING}, b AS (SELECT policy_id, string_agg('### doc ' || policy_id || ' · pág. ' || page_number || CASE WHEN coalesce(title, '') <> '' THEN ' · seção ' || title ELSE '' END || chr(10) || text, repeat(chr(10), 2) ORDER BY rank) AS body FROM reading GROUP BY 1), p AS (SELECT policy_id, {lit(IDENTIFICATION_HEAD)} || body AS prompt FROM b)
        SELECT policy_id, substr(sha256(prompt), 1, 12) AS prompt_hash, length(prompt)::INT AS prompt_chars FROM p""",
    "fill_prompts": f"""WITH {READING}, b AS (SELECT policy_id, string_agg('### doc ' || policy_id || ' · pág. ' || page_number || CASE WHEN coalesce(title, '') <> '' THEN ' · seção ' || title ELSE '' END || chr(10) || text, repeat(chr(10), 2) ORDER BY rank) AS body FROM reading GROUP BY 1),
        h(category, head) AS (VALUES {", ".join(f"({lit(c)}, {lit(fill_head(c, l))})" for c, l in REPORT_CATEGORIES)}), p AS (SELECT policy_id, category, head || chr(10) || body AS prompt FROM b, h)
        SELECT policy_id, category, substr(sha256(prompt), 1, 12) AS prompt_hash, length(prompt)::INT AS prompt_chars FROM p""",
    "report_prompts": f"""WITH {READING}, b AS (SELECT policy_id, string_agg('### doc ' || policy_id || ' · pág. ' || page_number || CASE WHEN coalesce(title, '') <> '' THEN ' · seção ' || title ELSE '' END || chr(10) || text, repeat(chr(10), 2) ORDER BY rank) AS body FROM reading GROUP BY 1),
        m AS (SELECT DISTINCT concat_ws('-', lang, (doc_id // 64)::VARCHAR) AS report_id, 'pol' || (doc_id // 8) AS policy_id, doc_id // 8 AS o FROM documents),
        r AS (SELECT report_id, string_agg('## Documento ' || policy_id || chr(10) || body, repeat(chr(10), 2) ORDER BY o) AS body FROM m JOIN b USING (policy_id) GROUP BY 1),
        h(kind, head) AS (VALUES {", ".join(f"({lit(k)}, {lit(v)})" for k, v in REPORT_HEADS.items())}), p AS (SELECT report_id, kind, head || body AS prompt FROM r, h)
        SELECT report_id, kind, substr(sha256(prompt), 1, 12) AS prompt_hash, length(prompt)::INT AS prompt_chars FROM p""",
    "keyed_log_orders": """WITH m AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
          UNION ALL SELECT o_orderkey, o_custkey, 'N' FROM orders WHERE o_orderstatus = 'P')
        SELECT * FROM m WHERE o_custkey % 10 <> 3 UNION ALL SELECT o_orderkey, o_custkey, 'R' FROM orders WHERE o_custkey % 20 = 3""",
    "keyed_merge": """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
        UNION ALL SELECT o_orderkey, o_custkey, 'N' FROM orders WHERE o_orderstatus = 'P'""",
    "latest_versions": "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 2) AS value FROM events GROUP BY 1, 2",
    "fact_scan": f"WITH {FACTS} SELECT policy_id, field_code, status FROM facts_v WHERE policy_id = '42'",
    "comparison_read": f"WITH {COMPARED} SELECT {COMPARISON_ID} AS comparison_id, field_code, resultado FROM grid_v WHERE a = 10 AND b = 11",
    "catalog_usage": f"SELECT ordinal::INT AS ordinal, field_code AS code, label, description, unit, (SELECT count(*) FROM customer) AS facts FROM {FIELDS}",
}
RAW_AMOUNT = "CASE (k + ordinal) % 3 WHEN 0 THEN 'R$ ' || translate(format('{:,.2f}', amount::DOUBLE), ',.', '.,') WHEN 1 THEN format('{:,.2f}', amount::DOUBLE) ELSE amount::VARCHAR END"
RAW_VALUE = f"""CASE field_type WHEN 'money' THEN '{{"amount":"' || {RAW_AMOUNT} || '","currency":"' || currency || '"}}'
    WHEN 'period' THEN '{{"start":"' || strftime(start_date, '%d/%m/%Y') || '","end":"' || strftime(end_date, '%d/%m/%Y') || '"}}'
    WHEN 'date' THEN '{{"date":"' || day(date) || '-' || month(date) || '-' || year(date) || '"}}'
    WHEN 'number' THEN CASE field_code WHEN 'indice_reajuste' THEN '{{"number":"' || k % 7 || ',50%"}}' ELSE '{{"number":"' || number_text || '"}}' END
    ELSE CASE field_code WHEN 'exclusoes_chave' THEN '{{"text":" Exclusão  ' || upper(substr(text, 10)) || '"}}' ELSE '{{"text":"'
      || CASE text WHEN 'america do sul' THEN 'América do Sul' WHEN 'europa' THEN ' EUROPA ' WHEN 'exterior' THEN 'Exterior' WHEN 'asia' THEN 'Ásia' ELSE 'Oriente  Médio' END || '"}}' END END"""
REVIEW_HEAD = (
    "Um analista apontou divergências. Decida quais fatos corrigir.\n" + JSON_HEAD + ' {"corrections": [{"fact_id", "decision", "value"}]}.\n'
    "decision: CORRIGIDO (exige value), DIVERGENTE ou CONFIRMADO. Use somente os fact_id listados.\n\n## Indicação\n"
)
ORACLES["review_prompts"] = f"""WITH {FACTS}, l AS (SELECT k, string_agg('- fact_id=' || fact_id || ' | ' || policy_id || ' | ' || field_code || ' | status=' || status || ' | valor=' || coalesce({RAW_VALUE}, 'ausente')
    || ' | evidências=' || coalesce(evidence_id, ''), chr(10) ORDER BY field_code) AS lines FROM facts_v GROUP BY 1),
  p AS (SELECT conv_id || '-' || turn AS message_id, {lit(REVIEW_HEAD)} || {strip('text')} || repeat(chr(10), 2) || '## Fatos' || chr(10) || lines AS prompt FROM conversations JOIN l ON k = conv_id WHERE role = 'user')
  SELECT message_id, substr(sha256(prompt), 1, 12) AS prompt_hash, length(prompt)::INT AS prompt_chars FROM p"""
INSURER_HEAD = (
    "Qual é a seguradora desta apólice? Dê preferência aos blocos [OCR/visão].\nSem certeza, devolva null.\n" + JSON_HEAD + ' {"name", "year"}.\n\n'
)
SHARE = "len(regexp_extract_all(c, '\\p{L}'))"
ORACLES["insurer_prompts"] = f"""WITH l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM (
    SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) AS i FROM documents)
    WHERE NOT regexp_matches({strip('line')}, '^\\[[^\\]]+\\]$')),
  t AS (SELECT doc_id, place, trim(regexp_replace(regexp_replace({strip('line')}, '^[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+', ''), '\\s+', ' ', 'g'), E' -:|\\t') AS c FROM l),
  named AS (SELECT doc_id, place, c FROM t WHERE length(c) BETWEEN 3 AND 60 AND len(string_split(c, ' ')) BETWEEN 1 AND 8 AND NOT regexp_matches(c, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]')
    AND {SHARE} >= 3 AND {SHARE} / length(c) >= 0.55 AND NOT regexp_matches(lower(c), {lit("|".join(m.replace(".", "[.]") for m in TITLE_MARKERS))})
    AND (regexp_matches(lower(c), {lit("|".join(m.replace(".", "[.]") for m in COMPANY_HINTS))}) OR (place <= {INSURER_HEADER_LINES} AND regexp_matches(c, '^\\p{{Lu}}')))),
  best AS (SELECT doc_id, arg_min(c, (-length(c), place)) AS b FROM named GROUP BY 1),
  read AS (SELECT doc_id FROM named JOIN best USING (doc_id) GROUP BY 1 HAVING bool_and(contains(lower(b), lower(c)))),
  p AS (SELECT doc_id::VARCHAR AS policy_id, {lit(INSURER_HEAD)} || '## Página 1' || chr(10) || coalesce(nullif({strip('text')}, ''), '(sem texto)') AS prompt FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM read))
  SELECT policy_id, substr(sha256(prompt), 1, 12) AS prompt_hash, length(prompt)::INT AS prompt_chars FROM p"""
POLICY_QUESTIONS = f"""WITH {VECTORS.replace("source AS policy_id, source AS document_id", SECTION_POLICY + " AS policy_id, source AS document_id")}, {QUESTIONS}, asked AS MATERIALIZED (SELECT query_id, conv_id, 'pol' || conv_id AS policy_id, {embed('query')} AS v FROM questions),
        {search('asked', 5, 'q.policy_id = c.policy_id')}, {READING},
        open_q AS (SELECT query_id, conv_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM hits)),
        filled AS (SELECT query_id, rank AS position, evidence_id FROM open_q JOIN reading ON conv_id % 2 = 0 AND policy_id = 'pol' || (conv_id // 2) WHERE rank <= 10)
        SELECT query_id, rank::INT AS position, 'ev_' || chunk_id AS evidence_id, 'search' AS origin FROM hits
        UNION ALL SELECT query_id, position::INT, evidence_id, 'fallback' FROM filled
        UNION ALL SELECT query_id, NULL::INT, NULL, 'notice' FROM open_q WHERE query_id NOT IN (SELECT query_id FROM filled)"""
ORACLES["cited_evidence"] = f"""WITH offered AS MATERIALIZED ({POLICY_QUESTIONS}),
  a AS (SELECT query_id, CASE WHEN split_part(query_id, '-', 1)::BIGINT % 3 = 0 THEN ['ev_x'] ELSE [evidence_id, 'ev_x'] END AS ids FROM offered WHERE position = 2),
  m AS (SELECT o.*, coalesce(list_contains(ids, evidence_id), false) AS hit FROM offered o JOIN a USING (query_id))
  SELECT query_id, position, evidence_id, origin FROM m WHERE hit OR query_id NOT IN (SELECT query_id FROM m WHERE hit)"""
ORACLES["parsed_objects"] = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN md5(text) END AS text_md5, CASE WHEN doc_id % 4 = 0 THEN 'ev' || doc_id END AS evidence_id,
  CASE WHEN doc_id % 4 <> 0 THEN 'LLM_SCHEMA_INVALID' END AS error_code FROM documents"""
ORACLES["comparison_issues"] = f"""WITH {ISSUES}, {PAIRS} SELECT a::VARCHAR AS policy_id_a, b::VARCHAR AS policy_id_b, (policy_id = b::VARCHAR)::INT AS side, policy_id, field_code, severity, reason
  FROM pairs_v JOIN issues_v ON policy_id IN (a::VARCHAR, b::VARCHAR)"""
LABELS = "(VALUES " + ", ".join(f"({i}, {lit(code)}, {lit(label)})" for i, (code, _, label) in enumerate(RANKING_CRITERIA, start=1)) + ") n(place, criterion, label)"
ORACLES["criterion_table"] = f"""SELECT scenario, ordinal::INT AS ordinal, criterion, label, {", ".join(f"max({NOTE}::DOUBLE) FILTER (s_suppkey = {p}) AS policy_{p}" for p in (1, 2, 3))}
  FROM supplier, {SCENARIOS} JOIN {LABELS} ON place = ordinal GROUP BY ALL"""
ORACLES["scalar_matches"] = f"""WITH x AS (SELECT *, ' ' || substr(text, doc_id % 7 + 1, 6) || chr(10) AS e FROM documents)
  SELECT doc_id, coalesce(contains(text, {strip("CASE WHEN doc_id % 2 = 0 THEN e ELSE reverse(e) END")}), false) AS text_matches,
    coalesce(CASE WHEN doc_id % 5 <> 0 THEN length(text) + (doc_id % 3 = 0)::INT END = n_chars, false) AS number_matches FROM x"""
ORACLES["vector_topk_pivots"] = ORACLES["vector_topk"]
ORACLES["comparison_bundles"] = ORACLES["comparison_markdown"]
ORACLES["bundled_documents"] = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents"
