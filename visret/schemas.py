"""Schemas of the files that the library reads; nothing is inferred."""

REGION = "struct<name: string, x0: int, y0: int, x1: int, y1: int>"
#: The elements of each array of an annotation file.
ANNOTATIONS = {
    "images": "id long, file_name string, width int, height int",
    "categories": "id long, name string",
    "annotations": "image_id long, category_id long, bbox array<double>",
}
QUERIES = "id string, query string"
JUDGMENTS = "query string, relevant_image_ids array<string>"
MANIFEST = "version int, model_id string, dimension int, image_count long, max_regions int, region_strategy string, metric string"
LAYOUT = "buckets int"
