"""The seven tables' schemas."""

from __future__ import annotations

TABLES = {
    "companies": "id long, stock_code string, stock_name string, exchange string, industry string, market_cap long, total_shares long, annual_revenue long, net_assets long, is_tracked boolean, tracked_since date, created_at timestamp_ntz, updated_at timestamp_ntz",
    "announcements": "id long, company_id long, announcement_id string, title string, full_text string, pdf_url string, published_date date, source_url string, raw_response string, fetched_at timestamp_ntz, processing_status string, error_message string",
    "classifications": "id long, announcement_id long, major_category string, sub_category string, confidence double, model_version string, industry string, industry_group string, classified_at timestamp_ntz",
    "extracted_fields": "id long, announcement_id long, field_name string, field_value string, field_type string, unit string, confidence double, model_used string, tokens_used long, extracted_at timestamp_ntz",
    "scores": "id long, announcement_id long, direction double, magnitude double, surprise double, credibility double, market_reaction double, composite_score double, score_version string, scoring_detail string, scored_at timestamp_ntz",
    "daily_reports": "id long, report_date date, industry_filter string, report_title string, report_content string, summary_text string, high_impact_count long, total_announcements long, generated_at timestamp_ntz",
    "pipeline_runs": "id long, run_id string, run_type string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, records_fetched long, records_processed long, records_failed long, error_message string, run_metadata string",
}
