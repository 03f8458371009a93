"""Table schemas, as DDL."""

IMAGE_TILES = (
    "site_id string, tile string, split string, path string, w int, h int, srid int, geo_transform array<double>, "
    "xmin double, ymin double, xmax double, ymax double, problem string"
)
MASK_TILES = (
    "site string, resolution string, dataset_version string, split string, tile_id string, mask_path string, "
    "height int, width int, classify array<int>, problem string"
)
TILES = (
    "tile_id string, site string, resolution string, dataset_version string, split string, mask_path string, "
    "image_path string, image_exists boolean, height int, width int, total_pixels bigint, pixels_no_data bigint, "
    "pixels_class_2 bigint, pixels_class_3 bigint, pixels_class_4 bigint, pixels_class_5 bigint, pixels_class_6 bigint, "
    "pixels_class_40 bigint, pixels_class_301 bigint, pixels_unmapped bigint, no_data_frac float, "
    "annot_bbox_area_frac float, annot_in_bbox_density float, n_unique_orig_classes smallint, scanned_at timestamp"
)
TILE_CLASSES = "tile_id string, site string, resolution string, split string, original_class_id int, pixel_count bigint"
