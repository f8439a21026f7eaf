"""Tables with every kind of awkward row, written to a folder of the test."""

from datetime import datetime

T0 = datetime(2024, 1, 1)
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, title string, source_type string, added_at timestamp",
    "extracted_documents": "document_id long, markdown string, metadata map<string,string>, fetched_at timestamp, loaded_at timestamp",
    "parents": "parent_id string, sec_no int, source string, source_type string, section string, page_start int, page_end int, source_url string, title string, source_id string, text string, built_at timestamp",
    "children": "child_id string, parent_id string, child_no int, source string, source_type string, section string, page int, child_type string, text string, embed_text string, indexed_at timestamp",
    "rag_results": "result_id long, query string, rewritten_query string, sub_queries array<string>, hits array<struct<parent_id:string,source:string,dist:double>>, contexts array<string>, answer string, refused boolean, asked_at timestamp, logged_at timestamp",
    "test_unanswerable_only": "item_id long, question string, contexts array<string>, ground_truth string, category string, added_at timestamp",
    "reranker_calibration": "question_id long, dataset string, retrieval_mode string, question string, category string, best_reranker_score double, is_unanswerable boolean, scored_at timestamp",
    "size_limits": "item_field string, max_chars int, overlap_chars int",
    "keep_targets": "dataset string, category string, target_fraction double",
    "source_weights": "source string, target_share double, max_repeats int",
    "pack_capacities": "container_kind string, capacity_tokens int",
}
LONG = "The model learns the weights. " * 3000
ROWS = {
    "documents": [(1, None, None, None, 0, None, None, None), (2, "", "en", "a", 0, None, None, T0), (3, LONG, "en", "a", 9, "t", "web", T0), (4, "﻿\n ", "xx", "b", 3, None, None, T0), (5, "x" * 40_000, None, "b", 1, None, None, T0), (6, "One. Two.", "en", "b", 9, None, None, T0), (7, "One. Two.", "en", "b", 9, None, None, T0)],
    "extracted_documents": [(1, None, None, None, None), (2, "", {"source_url": "https://h.test/a"}, T0, T0), (3, LONG, {"source_url": "not a url"}, T0, T0), (4, "# A\n\nText.\n\n© 2020 H. All rights reserved.", {"source_url": "https://h.test/b"}, T0, T0), (4, "# A\n\nText.\n\n© 2020 H. All rights reserved.", {"source_url": "https://h.test/b"}, T0, None), (5, "<!-- loc page=1 -->\n\n- 1 -\n\nA wo-\nrd here.", {"source_id": "s"}, T0, T0), (6, "\n\n\n", {"source_id": "s2"}, T0, T0), (None, "x", {"source_id": "s"}, T0, T0), (7, LONG, {"source_id": "s3"}, T0, T0)],
    "parents": [(None,) * 12, ("p1", 1, "a", None, None, None, None, None, None, None, LONG, T0), ("p1", 1, "a", None, None, None, None, None, None, None, LONG, None), ("p2", 2, "a", "web", "S", 1, 1, None, None, None, "", T0), ("p3", 3, "a", "web", "S", 1, 1, None, None, None, "a <b>c</b> **d** [[e]] \\emph{f} x < y and y > z", T0)],
    "children": [(None,) * 11, ("c1", "p1", 0, "a", None, None, None, None, "z" * 5000, "z" * 5100, T0), ("c1", "p1", 0, "a", None, None, None, None, "z" * 5000, "z" * 5100, None), ("c2", "p1", 1, "a", None, None, None, None, LONG, LONG, T0), ("c3", "p2", 0, "a", None, None, None, None, "", "", T0)],
    "rag_results": [(None, "q", None, None, None, None, "a", None, None, None), (1, None, None, None, None, None, None, None, None, None), (2, "", "", [], [], [], "", True, T0, T0), (3, "What is a layer?", None, ["x"], [("p1", "a", 0.5)], ["c"], LONG, False, T0, T0), (4, "What is a layer?", None, None, None, None, "What is a layer?", None, T0, T0), (4, "What is a layer?", None, None, None, None, "What is a layer?", None, T0, T0)],
    "test_unanswerable_only": [(None, None, None, None, None, None), (1, "Who?", [], "N/A", "unanswerable", T0), (2, "Who?", None, "I must decline to answer.", "unanswerable", T0), (3, "Who?", None, "I must decline to answer.", None, T0)],
    "reranker_calibration": [(None, "d", "m", "q", "c", 0.5, True, T0), (1, "d", "m", "q", "c", float("nan"), True, T0), (2, "d", "m", "q", "c", None, True, T0), (3, "d", "m", "q", "c", 1.5, True, T0), (4, "d", "m", "q", "c", 0.5, None, T0), (5, "d", "m", "q", "c", 0.5, False, T0), (6, "d", "m", "q", "c", 0.5, True, T0), (7, "d", "m", "q", "c", 0.25, True, T0), (7, "d", "m", "q", "c", 0.25, True, None), (8, "d", "m", "q", None, 0.75, True, T0), (9, None, "m", "q", "c", 0.75, True, T0)],
    "size_limits": [("children.text", 750, 80), ("children.embed_text", 1000, 80), ("parents.text", 3000, 200), (None, None, None)],
    "keep_targets": [("d", "c", 0.5), ("d", None, 1.0), ("absent", "c", 0.1), ("d", "none", None)],
    "source_weights": [("a", 0.5, 1), ("b", 0.5, 2), ("absent", 0.1, 1), (None, 0.2, 1), ("zero", 0.0, 1), ("none", None, None)],
    "pack_capacities": [("small", 512), ("large", 8192), (None, 5), ("nil", None), ("bad", 0)],
}
# names that operators use inside
CLASHES = ["g", "score", "h", "body", "tokens", "bucket", "key", "weight", "k", "t", "x", "url", "host", "path", "question", "reply", "source_key", "piece", "size", "bin", "word", "n", "unit", "width", "share", "document"]


def write(spark, folder, rows=None, clash=False):
    from pyspark.sql import functions as F

    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(ROWS[name] if rows is None else rows.get(name, []), schema)
        if clash:
            df = df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder
