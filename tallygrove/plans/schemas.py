"""Result columns of every query: the same names and types in Spark and SQL, doubles rounded to six places."""

from tallygrove.operators.features import COLUMNS

SCHEMAS = {
    "jaccard_near_dups": "a bigint, b bigint, jaccard double",
    "activity_features": "report_id bigint, author bigint, priority int, prior_count bigint, prior_mean double, prior_median double, n_30d bigint, n_90d bigint",
    "prior_author_stats": "report_id bigint, prior_count bigint, prior_mean double, prior_median double",
    "trailing_counts": "event_id bigint, n_1d bigint, n_3d bigint, n_7d bigint, n_30d bigint, type_7d bigint, type_30d bigint",
    "component_priority_stats": "report_id bigint, n_30d bigint, n_90d bigint, n_before bigint, mean_30d double, median_30d double, share_p1 double, share_p2 double, share_p3 double, share_p4 double, share_p5 double",
    "same_or_higher_severity": "report_id bigint, same_7d bigint, same_30d bigint, higher_7d bigint, higher_30d bigint",
    "asof_history": "o_orderkey bigint, last_owner bigint",
    "history_cutoff": "reason string, component string, n bigint, owners bigint",
    "recency_share": "component string, owner bigint, weight double, n bigint, share double",
    "interval_eligibility": "event_id bigint, n_valid bigint, first_span bigint",
    "rolling_windows": "kind string, step bigint, part string, n bigint, owners bigint, in_roster bigint",
    "temporal_split": "report_id bigint, part string",
    "confusion_matrix": "quality int, said_0 bigint, said_1 bigint",
    "label_scores": "label int, support bigint, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double",
    "macro_scores": "macro_f1 double, weighted_f1 double, macro_recall double, min_recall double, accuracy double",
    "priority_metrics": "n bigint, accuracy double, off_by_one double, mae double, recall_p1 double, recall_p2 double, recall_p3 double, recall_p4 double, recall_p5 double",
    "threshold_sweep": "threshold double, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double, accuracy double",
    "best_threshold": "f1 double, precision double, recall double, accuracy double, threshold double, tp bigint, fp bigint, fn bigint",
    "auroc": "positives bigint, total bigint, auroc double",
    "calibration_ece": "ece double, mce double, brier double, n bigint",
    "psi_drift": "psi double, bins bigint",
    "wilson_by_group": "lang string, k bigint, n bigint, low double, high double",
    "embedding_topk": "query_id bigint, item_id bigint, score double, rank int",
    "map_mrr_recall": "query_id bigint, n_relevant bigint, first_rank int, ap double, rr double, hit_1 int, hit_5 int, hit_10 int, recall_1 double, recall_5 double, recall_10 double",
    "owner_entropy": "component string, n bigint, distinct bigint, entropy double, normalised double",
    "latency_percentiles": "event_type string, p50 double, p95 double, median double, mean double, least double, most double",
    "weekly_shadow": "iso_year int, iso_week int, n bigint, owners bigint, error_rate double",
    "field_accuracy": "n bigint, quality_accuracy double, toxic_accuracy double, exact_match double, missing_prediction bigint, extra_prediction bigint",
    "risk_coverage": "threshold double, answered bigint, coverage double, accuracy double, risk double",
    "confidence_bins": "bin bigint, n bigint, accuracy double, confidence double",
    "group_macro": "lang string, sources bigint, n bigint, macro_accuracy double, macro_min_rows double",
    "class_imbalance": "classes bigint, imbalance double, top_share double, singletons bigint",
    "top_values": "event_type string, n bigint, share double",
    "sample_size_plan": "p double, n_needed int",
    "bootstrap_ci": "low double, high double, mean double",
    "clean_documents": "doc_id bigint, source string, text string, text_len int",
    "page_text": "page_id bigint, host string, text string, n int",
    "canonical_priority": "o_orderpriority string, priority string, n bigint",
    "extract_references": "page_id bigint, urls array<string>, paths array<string>, names array<string>",
    "first_comment": "conv_id bigint, turn bigint, text string",
    "tfidf_topk": "item_id bigint, doc_id bigint, score double, rank int",
    "bm25_topk": "item_id bigint, doc_id bigint, score double, rank int",
    "bm25f_related": "item_id bigint, doc_id bigint, score double, rank int",
    "simhash_near_dups": "a bigint, b bigint, distance bigint",
    "duplicate_components": "doc_id bigint, component bigint",
    "overlap_audit": "item_id bigint, n_docs bigint, first_doc bigint",
    "missing_masters": "id bigint",
    "title_similarity": "query_id bigint, item_id bigint, score double, rank int",
    "keyword_features": "doc_id bigint, " + ", ".join(f"{c} int" for c in COLUMNS),
    "allowed_values": "lang string, value string, n bigint",
    "observable_fields": "field string, n bigint, observed bigint",
    "owner_counts": "level string, owner bigint, component string, product string, n bigint",
    "ownership_derive": "component string, product string, owner bigint, support bigint, share double",
    "roster_snapshot": "owner bigint, n bigint, n_active bigint, n_dormant bigint, last_seen timestamp_ntz, status string",
    "owner_shares": "component string, owner bigint, n bigint, share double, log_n double",
    "quota_candidates": "component string, owner bigint, score double, from_source string, place int",
    "routing_ladder": "component string, product string, owner bigint, confidence double, calibrated double, novelty_risk double, status string",
    "policy_grid": "threshold double, coverage double, accuracy double",
    "routing_metrics": "status string, n bigint, confidence double, risk double",
    "owner_known_groups": "known string, component string, rows bigint, owners bigint",
    "metadata_rerank": "query_id bigint, item_id bigint, final double, new_rank int",
    "stable_rerank": "query_id bigint, item_id bigint, blend double",
    "hash_folds": "report_id bigint, fold int, bucket bigint",
    "stratified_holdout": "report_id bigint, priority int",
    "triplets_hard": "anchor bigint, positive bigint, negative bigint",
    "pairwise_rows": "query_id bigint, item_id bigint, diff double, target int, weight double",
    "latest_feedback": "user_id bigint, event_type string, ts timestamp_ntz, event_id bigint, value double",
    "feedback_override": "ticket bigint, owner bigint",
    "priority_score": "band string, n bigint, score double",
    "label_masking": "s_suppkey bigint, masked string",
    "rank_union": "query_id bigint, item_id bigint, a double, b double, side string",
    "leakage_audit": "item_id bigint, n bigint",
    "partition_digest": "lang string, n bigint, first_digest string, last_digest string",
    "readiness_gates": "enough_rows boolean, balanced boolean, has_toxic boolean, unique_ids boolean",
    "latest_weeks_gate": "event_type string, passes boolean, weeks bigint",
    "eviction_plan": "doc_id bigint, n_chars bigint",
    "paired_outcomes": "o_orderkey bigint, outcome string",
    "code_windows": "doc_id bigint, start_line int, end_line int, digest string",
    "graph_one_hop": "o_custkey bigint, file bigint, bonus double",
    "path_suffix": "page_id bigint, doc_id bigint, path string",
    "line_symbols": "path bigint, state string, n bigint, first_symbol string",
    "file_aggregation": "query_id bigint, file bigint, chunks bigint, score double, rank int",
    "coverage_quota": "query_id bigint, item_id bigint, place int",
    "stream_replay": "day timestamp_ntz, event_type string, n bigint, total double",
    "stream_latest": "user_id bigint, event_id bigint, event_type string, value double",
    "stream_dedup": "user_id bigint, n bigint, payloads bigint",
    "rolling_replay": "name string, queries bigint, usable bigint, overlapping bigint",
    "priority_fit": "actual int, said int, n bigint",
    "ltr_fit": "query_id bigint, item_id bigint, rel int, new_rank int",
    "calibrated_scores": "bin bigint, n bigint, isotonic double, platt double, rate double",
    "alias_resolution": "c_custkey bigint, final bigint",
    "snapshot_labels": "event_id bigint, snapshot bigint",
    "cluster_collapse": "doc_id bigint, representative bigint, size bigint",
    "content_digests": "lang string, digest string, n bigint",
    "history_prefilter": "author bigint, n bigint, kept boolean",
    "repository_holdout": "source string, n bigint, part string",
    "representative_tickets": "lang string, doc_id bigint, place int",
    "rank_agreement": "query_id bigint, item_id bigint, agreement double",
    "score_margins": "query_id bigint, best double, second double, margin double",
    "related_topk_stats": "query_id bigint, mean_1 double, least_1 int, most_1 int, median_1 double, mean_3 double, least_3 int, most_3 int, median_3 double, mean_5 double, least_5 int, most_5 int, median_5 double, mean_10 double, least_10 int, most_10 int, median_10 double",
    "owner_bm25": "item_id bigint, source string, owner_score double, place int",
    "owner_keywords": "source string, token string, weight double, place int",
    "char_ngram_topk": "item_id bigint, conv_id bigint, score double, rank int",
    "ticket_sufficiency": "missing string, usable boolean, n bigint",
    "event_properties": "event_type string, k_sum bigint, bad bigint, n bigint",
    "operating_points": "fpr_at_80 double, fpr_at_95 double, recall_at_5 double, recall_at_20 double",
    "baseline_comparison": "baseline string, n bigint, hits bigint",
    "pool_decomposition": "state string, n bigint",
    "leave_owner_out": "fold int, hidden_rows bigint, hidden_owners bigint, history_rows bigint",
    "gold_alignment": "quality int, gold bigint, answered bigint, accuracy double",
    "relevant_sets": "vec_id bigint, head bigint, n_relevant bigint",
    "run_status": "status string, runs bigint, mean_stages double, most_stages bigint",
    "error_taxonomy": "kind string, n bigint",
    "field_overlap": "rows_ bigint, ids bigint, contents bigint, sources bigint, empty bigint",
    "frequency_buckets": "bucket string, authors bigint, reports bigint",
    "time_features": "event_id bigint, hour_sin double, hour_cos double, day_sin double, day_cos double, value double",
    "chunk_signals": "query_id bigint, best double, margin double, gate string",
    "score_blend": "doc_id bigint, blend double",
    "component_thresholds": "lang string, threshold double, coverage double, accuracy double",
    "sequential_exclusion": "doc_id bigint",
    "fold_means": "lang string, queries bigint, top_1 double, map double, seconds bigint",
    "triplet_cap": "anchor bigint, positive bigint, negative bigint, is_priority boolean",
    "non_duplicates": "doc_id bigint, lang string",
    "stage_outcome": "query_id bigint, n_gold bigint, found bigint, hit int, recall double, outcome string",
    "patch_overlap": "l_orderkey bigint, n_predicted bigint, n_reference bigint, n_common bigint, exact boolean",
    "gold_in_snapshot": "l_orderkey bigint, n_gold bigint, n_present bigint, any_present boolean, all_present boolean",
    "change_audit": "split string, n bigint, changed_after_start bigint, changed_after_end bigint, eligible_history bigint",
    "evidence_ablation": "cutoff int, source string, hits bigint, supported bigint, unique bigint, retained bigint",
    "holdout_registry": "event_id bigint, content string, sealed boolean, n_runs bigint",
    "review_queue": "doc_id bigint, confidence double, confidence_label string, review_priority string",
    "demo_cases": "source string, doc_id bigint, is_miss boolean, place int",
    "auprc": "positives bigint, total bigint, auprc double",
    "quantile_grid": "step int, value double",
    "csv_tickets": "ticket_id string, title string, duplicate_of string, size int",
    "jsonl_scan": "doc_id bigint, digest string, broken boolean",
    "record_scan": "id string, name string",
    "tracker_pages": "kind string, ticket_id string, title string",
    "structured_tickets": "ticket_id string, bug_type string, error_message string, steps string",
    "history_records": "ticket_id string, known_at timestamp_ntz, label_availability_source string",
    "record_import": "id bigint, v double",
    "labelled_text": "s_suppkey bigint, title string, os string, version string",
    "vocabulary": "value string, n bigint",
    "json_repair": "p_partkey bigint, size int, tags string",
    "symbol_spans": "path string, symbol string, line int, end_line int, id_length int",
    "diff_hunks": "s_suppkey bigint, path string, line int, kind string",
    "stage_checkpoints": "stage string, ticket_id string, name string",
    "feedback_log": "day string, n bigint, first_event bigint",
    "embedding_cache": "text string, n bigint, total double, encoded bigint",
    "time_forms": "event_id bigint, at timestamp_ntz",
    "resume_ids": "ticket_id bigint",
    "symbol_match": "k bigint, match string",
}
