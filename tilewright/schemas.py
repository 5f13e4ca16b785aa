"""Table schemas of the imaging data model, as DDL."""

REGISTRY = "marker_name string, compartment string, family string, compartment_desc string, family_desc string, marker_full_name string"
MARKER_MAP = "original_name string, mapped_canonical_name string, status string, suggestion_1 string, suggestion_2 string"
ADDITIONAL_MARKERS = "marker_name string, compartment string, family string, compartment_desc string, family_desc string, marker_full_name string, mean string, std string, pretraining string"
MPP_TABLE = "image string, mpp double"
CHANNELS = "slide_id string, channel_idx int, raw string, marker string, match string, keep boolean"
SLIDES = "slide_id string, name string, ext string, image_path string, store_path string, height int, width int, n_markers int, mpp double, nuclear_marker string, source_pyramid_levels int, dtype string"
TILES = "slide_id string, channel_idx int, ty int, tx int, y0 int, x0 int, h int, w int, dtype string, data binary"
PIXELS = "slide_id string, channel_idx int, y int, x int, v double"
POLYGONS = "slide_id string, method string, tissue_id int, rings array<array<struct<x:double,y:double>>>"
TISSUE_RUNS = "slide_id string, method string, y int, x_start int, x_end int"
CELL_RUNS = "slide_id string, y int, x_start int, x_end int, cell_id int"
CELLS = "slide string, cell_id int, x double, y double, cell_area bigint"
CELL_LABELS = "cell_id int, label_set string, label string"
PATCHES = "slide_id string, slug string, patch_idx bigint, x int, y int, tissue_prop float, cell_id int"
FEATURES = "slide_id string, slug string, encoder string, variant string, patch_idx bigint, features array<double>"
PARTIALS = "slide_id string, marker string, n_pixels bigint, mean double, var double, region_key string"
TASKS = "slide_id string, stage string, key string, status string, started_at string, completed_at string, error string, outputs map<string,string>"
RUNS = "run_id string, tool string, started_at string, finished_at string, status string, error string, host string, pid int, job_dir string, args map<string,string>"
