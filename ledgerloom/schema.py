"""Table schemas, as DDL, and fixed values."""

from __future__ import annotations

# Fixed values.
ENTITY_LABELS = ["Company", "Executive", "Product", "FinancialMetric", "RiskFactor", "MacroEvent", "FinancialEvent"]
RELATION_TYPES = ["CAUSED", "MENTIONS", "COMPETES_WITH", "DEPENDS_ON", "IMPACTED", "REPORTED_BY", "HAS_EXECUTIVE"]
CAUSAL_TYPES = ["CAUSED", "IMPACTED", "DEPENDS_ON", "REPORTED_BY", "HAS_EXECUTIVE"]
KEY_SECTIONS = ["MD&A", "RISK", "EARNINGS"]
TOOLS = ["chunk_search", "table_search", "graph_traversal"]
JOB_STATES = ["QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]
DOCUMENT_STATES = ["UPLOADED", "INGESTING", "INGESTED", "FAILED"]

STAGES = ["UPLOADING", "PARSING", "CHUNKING", "EMBEDDING", "EXTRACTION", "WRITING"]
#: States that may follow a state; a repeated state is an update.
JOB_NEXT = {"QUEUED": ["RUNNING", "CANCELLED", "FAILED"], "RUNNING": ["COMPLETED", "FAILED", "CANCELLED"], "COMPLETED": [], "FAILED": [], "CANCELLED": []}
DOCUMENT_NEXT = {"UPLOADED": ["INGESTING", "FAILED"], "INGESTING": ["INGESTED", "FAILED"], "INGESTED": ["INGESTING"], "FAILED": ["INGESTING"]}

MOST_HITS = 20
MAX_ENTITY_CHUNKS = 20
QUALITY_MIN_EVIDENCE = 2
QUALITY_MIN_SCORE = 0.35
CLAIM_BLOCK = 0.40
CLAIM_DOWNGRADE = 0.80
COVERAGE_FLOOR = 0.50

COMPANY = "name string, ticker string"
DOCUMENT = (
    "id string, filename string, file_path string, mime_type string, size_bytes long, ticker string, company_name string, doc_type string, "
    "type string, period string, status string, created_at timestamp, updated_at timestamp, stats map<string, long>, error_message string"
)

SECTION = "id string, doc_id string, idx int, title string, section_type string, page_start int, page_end int"
CHUNK = "id string, section_id string, doc_id string, text string, section_type string, page int, sequence int, embedding array<float>"
DOC_TABLE = "id string, section_id string, markdown string, sequence int, embedding array<float>"
ENTITY = "label string, name string"
MENTION = "chunk_id string, label string, name string"
RELATION = "src_name string, tgt_name string, rel_type string"
JOB = (
    "id string, status string, stage string, progress int, message string, documents_count int, created_at timestamp, started_at timestamp, "
    "updated_at timestamp, stats map<string, long>, error_message string"
)

PARSED_SECTION = "section_type string, title string, content string, tables array<string>, headings array<string>, page_start int, page_end int"
EXTRACTION = "struct<entities array<struct<name string, type string, properties map<string,string>>>, relations array<struct<source string, target string, relationship string, properties map<string,string>>>>"
TESTSET = "category string, question string, reference string, ticker string, period string, expected_domain string, retrieval_hint string"
EVIDENCE = ["source_type", "source_id", "doc_id", "doc_type", "period", "section_id", "section_type", "page", "score", "ticker", "text"]

#: What a question leaves behind, as read by evaluation.
STATE = (
    "case_id long, final_answer struct<answer string, confidence string, bullets array<string>, citations array<struct<source_type string, source_id string>>>, "
    "evidence array<struct<source_type string, source_id string>>, chunk_hits array<string>, table_hits array<string>, "
    "retrieval_quality struct<evidence_count int, avg_score double>, "
    "evaluation_signals struct<citation_coverage double, confidence string, claim_support_ratio double, claim_total_count int, unsupported_claim_count int, confidence_overridden boolean>, "
    "policy_flags struct<domain_gate_passed boolean, domain_confidence string, domain_reason string, domain_signals array<string>, domain_adjudication_used boolean>, "
    "domain_status string, retry_count int, error_class string, blocked_reason string"
)

#: Keys that must be unique, by table.
KEYS = {"company": ["name"], "company_ticker": ["ticker"], "document": ["id"], "section": ["id"], "chunk": ["id"], "doc_table": ["id"], "entity": ["label", "name"], "job": ["id"]}
