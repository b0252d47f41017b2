"""Schemas of the tables that the operators pass on."""

DOCUMENT = "id string, content string, source string, document_type string, metadata map<string,string>, full_metadata struct<author:string,title:string,created:timestamp,modified:timestamp,tags:array<string>>, created_at timestamp"
CHUNK_META = "struct<chunk_index:int,total_chunks:int,chunk_type:string,has_overlap:boolean,overlap_chars:int>"
CHUNK = f"id string, document_id string, content string, start_idx int, end_idx int, metadata map<string,string>, sentence_count int, chunk_meta {CHUNK_META}"
VECTOR = CHUNK + ", embedding array<float>, collection string"
QUESTION = "question_id long, question string"
RESULT = "question_id long, rank int, chunk_id string, score double, source string, content string"
PAGE = "chapter int, page_number int, source string, text string"
EVAL_QUESTION = "question string, expected_answer_contains array<string>, expected_citations_min int, expected_refusal boolean, refusal_reason string, tags array<string>, difficulty string"
DOCUMENT_TYPES = ("pdf", "txt", "md", "html", "json")
DIFFICULTIES = ("easy", "medium", "hard")
MODES = ("vector", "graph", "hybrid")
