"""Tables of the corpus as schemas in DDL, and the vocabularies their columns are held to."""

from __future__ import annotations

_CONSTRUCTS = "array<struct<id:string,role:string,direction:string>>"

PAPERS = (
    "paper_id string, doi string, title string, authors array<string>, year int, venue string, publisher string, abstract string, url string, source string,"
    "ingest_method string, finder_run_id string, retrieved_at timestamp, pdf_path string, pdf_sha256 string, pdf_bytes bigint, pdf_source string, status string,"
    "triage_score double, triage_decision string, triage_reasons array<string>, ae_job_path string, ae_output_path string, ae_run_id string, ae_profile string,"
    "ae_status string, ae_n_claims int, ae_n_rules int, ae_confidence double, ae_warnings array<string>, topic_score double, topic_decision string, topic_stage string,"
    "topic_category string, off_topic_flag boolean, off_topic_score double, tags array<string>, human_notes string, created_at timestamp, updated_at timestamp"
)
FACET_NODES = ("node_id string, facet_id string, parent_id string, level int, name string, description string, seeds array<string>")
NODE_CENTROIDS = ("node_id string, embedding array<float>, model string, exemplar_papers array<string>, computed_at timestamp")
PAPER_FACET_SCORES = ("paper_id string, node_id string, score double, method string, classified_at timestamp")
CITATIONS = ("source_paper_id string, cited_paper_id string, cited_doi string, cited_title string, cited_authors array<string>, cited_year int, citation_context string, discovered_via string, created_at timestamp")
EXPANSION_QUEUE = ("doi string, title string, authors array<string>, year int, discovered_from string, discovery_count int, priority_score double, status string, rejection_reason string")
CLAIMS = (
    f"claim_id string, paper_id string, claim_type string, statement string, environment_factors {_CONSTRUCTS}, outcomes {_CONSTRUCTS}, mediators {_CONSTRUCTS}, moderators {_CONSTRUCTS},"
    "design string, sample_n int, population string, setting string, task string, effect_size_type string, effect_size_value double, p_value double, ci95_low double, ci95_high double,"
    "evidence_spans array<struct<kind:string,source:string,start:int,end:int>>, ae_confidence double, ae_run_id string"
)
RULES = ("rule_id string, paper_id string, rule_type string, lhs array<struct<var:string,state:string>>, rhs array<struct<var:string,state:string>>, polarity string, strength_kind string, strength_type string, strength_value double, population string, setting string, boundary_conditions array<string>, evidence_links array<string>, ae_confidence double")
EXTRACTED_TABLES = ("table_id string, paper_id string, table_number int, caption string, table_type string, raw_html string, structured_json string, markdown string, page_number int, extraction_method string, extraction_confidence double, has_statistics boolean, has_sample_sizes boolean, needs_review boolean, reviewed_at timestamp")
QUERY_LOG = ("query_id string, api string, query_text string, status string, started_at timestamp, ended_at timestamp, duration_ms bigint, results int, new_results int, accepted int, rejected int, duplicates int, cell_id string, gap_id string, error string, context map<string,string>")

# Vocabularies of the data model.
STATUS_TRANSITIONS = {
    "candidate": ["pending_scorer", "rejected", "downloaded", "queued_for_eater"],
    "pending_scorer": ["candidate", "rejected", "downloaded", "queued_for_eater"],
    "rejected": [],
    "downloaded": ["queued_for_eater", "rejected"],
    "queued_for_eater": ["sent_to_eater", "rejected"],
    "sent_to_eater": ["eater_running"],
    "eater_running": ["processed_success", "processed_partial", "processed_fail"],
    "processed_success": ["needs_human_review"],
    "processed_partial": ["needs_human_review", "queued_for_eater"],
    "processed_fail": ["queued_for_eater", "rejected"],
    "needs_human_review": ["processed_success", "rejected", "queued_for_eater"],
}
#: The verifiers accept every state of the machine.
STATUSES = tuple(STATUS_TRANSITIONS)
TRIAGE_DECISIONS = ("pending", "send_to_eater", "review", "reject")
DEPRECATED_DECISIONS = {"needs_review": "review"}
AE_STATUS = ("pending", "SUCCESS", "PARTIAL_SUCCESS", "FAIL")
TOPIC_DECISIONS = ("on_topic", "off_topic", "needs_abstract", "possibly_off_topic")
MATCH_STATUS = ("matched", "unmatched", "ambiguous")
MATCH_BASIS = ("exact_doi", "exact_title_year", "exact_title", "none")
CLAIM_TYPES = ("causal", "associational", "null", "moderated", "mechanistic", "descriptive")
RULE_TYPES = ("edge", "cpd_hint", "prior", "constraint", "interaction")
POLARITIES = ("positive", "negative", "null", "u_shaped", "unknown")
QUEUE_STATUS = ("pending", "fetching", "fetched", "not_found", "rejected", "processed")
GAP_TYPES = ("coverage", "theory", "mechanism", "neural", "boundary")
CELL_TYPES = ("factor_outcome", "theory", "neural", "mechanism")
LOG_STATUS = ("started", "completed", "error", "timeout", "rate_limited")
