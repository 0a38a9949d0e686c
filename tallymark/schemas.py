"""Schemas of the tables; never inferred."""

from __future__ import annotations

PRODUCTS = (
    "reference_product_id string, brand string, product_name string, barcode string, mrp double, net_weight string, manufacturer string, batch_no string, "
    "pkd string, best_before string, use_by string, reference_ocr_text string, reference_fields_json string, reference_image string, reference_image_url string, source_note string"
)
RULES = (
    "rule_code string, rule_name string, category string, field_name string, operator string, expected_value string, severity string, description string, "
    "source_reference string, source_url string, effective_from date, effective_to date, version string, is_active boolean"
)
SCAN_RECORDS = "scan_id long, created_at timestamp, image_path string, image_url string, detected_barcode string, detected_product_name string, detected_brand string, reference_product_id string, ocr_confidence double, tampering_score double, status string"
OCR_RESULTS = "scan_id long, raw_text string, confidence double, structured_data string"
BARCODE_RESULTS = "scan_id long, barcode string, detected boolean, confidence double"
TAMPERING_RESULTS = "scan_id long, tampering_score double, status string, heatmap_path string"
COMPLIANCE_RESULTS = "scan_id long, overall_status string, risk_level string, reference_match boolean, matched_fields string, mismatched_fields string, missing_fields string, rule_results string, explanation string, engine_version string, rules_version string, processing_time_ms int"
OCR_WORDS = "scan_id long, pass_no int, pos int, block_num int, par_num int, line_num int, text string, conf double, left double, top double, width double, height double"
BARCODE_CANDIDATES = "scan_id long, pos int, value string, type string, x int, y int, w int, h int"
SEVERITIES = ("low", "medium", "high")
