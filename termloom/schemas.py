"""Schemas of the stored and read tables."""

from pyspark.sql import types as T

TERMS = T.StructType([T.StructField("id", T.LongType(), False), *[T.StructField(c, T.StringType(), False) for c in ("source_term", "source_language", "target_term", "target_language")], *[T.StructField(c, T.StringType()) for c in ("context", "contributor")], T.StructField("date_added", T.TimestampType()), T.StructField("verified_status", T.StringType()), T.StructField("notes", T.StringType())])
#: public TSV format of word-level OCR output
TSV_WORDS = T.StructType([T.StructField(c, T.StringType()) for c in ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")])
CONFIG = T.StructType([*[T.StructField(c, T.StringType()) for c in ("page_type", "line_break_method", "recognizer", "segmenter", "line_cluster_pos")], *[T.StructField(c, T.DoubleType()) for c in ("break_width", "combine_hangoff")], T.StructField("line_cut_inflation", T.IntegerType()), *[T.StructField(c, T.BooleanType()) for c in ("low_ink", "viterbi_postprocessing", "postprocess", "stop_line_cut", "detect_o", "clear_hr")]])
