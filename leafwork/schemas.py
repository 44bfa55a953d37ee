"""Schemas of the tables that the engine reads and makes."""

from .functions.geometry import BOX

SPANS = "array<struct<text: string, size: double, font: string, flags: int>>"
LAYOUT_BLOCKS = f"doc_id long, page int, block_no int, box {BOX}, page_w double, page_h double, block_type int, lines array<struct<spans: {SPANS}>>"
BLOCKS = f"doc_id long, page int, block_no int, box {BOX}, page_w double, page_h double, text string, block_type int, font_size double, is_bold boolean"
PARAGRAPHS = f"doc_id long, seq long, page int, section_id long, section_title string, heading_level int, text string, box {BOX}, kind string, font_size double, is_bold boolean"
FIGURES = f"doc_id long, figure_id string, page int, caption string, box {BOX}, caption_box {BOX}, image_source string, warning string"
DEVICE = (
    "device_label string, sample_role string, material_system string, perovskite_composition string, device_structure string, substrate string, etl string, "
    "interface_layers array<string>, htl string, electrode string, active_area_cm2 double, voc_v double, jsc_ma_cm2 double, ff_percent double, pce_percent double, "
    "certified_pce_percent double, steady_state_pce_percent double, scan_direction string, source_text string, source_page int, source_figure string"
)
STABILITY = (
    "device_label string, sample_role string, material_system string, device_structure string, test_type string, protocol string, temperature_c double, "
    "relative_humidity_percent double, light_condition string, illumination_intensity string, tracking_mode string, bias_condition string, atmosphere string, "
    "encapsulated boolean, duration_h double, cycles int, cycle_profile string, initial_pce_percent double, retained_pce_operator string, retained_pce_percent double, "
    "final_pce_percent double, t80_h double, t95_h double, qualitative_result string, source_text string, source_page int, source_figure string, source_panel string"
)
JOB_STATUS = (
    "job_id string, status string, message string, progress double, uploaded_name string, input_path string, output_root string, "
    "result string, error string, created_at double, updated_at double"
)
