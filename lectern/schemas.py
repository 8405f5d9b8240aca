"""Schemas of the archive's tables, as DDL. Readers use these; nothing is inferred from data."""

TAGS = "array<string>"
CHUNK_FIELDS = {
    "chunk_id": "string", "document_id": "string", "title": "string", "author": "string", "date": "string", "source_collection": "string", "source_url": "string", "document_type": "string",
    "issue_tags": TAGS, "constitutional_clause_tags": TAGS, "text": "string", "word_count": "int", "preview": "string", "pos": "bigint",
}
#: Columns that may be absent from a chunk on read; they default to empty.
CHUNK_OPTIONAL = ("title", "author", "date", "source_collection", "source_url", "document_type", "issue_tags", "constitutional_clause_tags", "preview")


def struct(fields: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in fields.items()) + ">"


CHUNK = ", ".join(f"{n} {t}" for n, t in CHUNK_FIELDS.items())
DOCUMENT = "id string, title string, author string, date string, source_collection string, source_url string, document_type string, text string, metadata map<string,string>"
EVENT = f"id string, date string, phase string, title string, summary string, actors {TAGS}, locations {TAGS}, source_chunks {TAGS}, cross_refs {TAGS}"
POSTING = "term string, chunk_id string, tf int"
DOCSTAT = "chunk_id string, dl int"
CITATION = "chunk_id string, kind string, target string, key string, byte_offset int, matched_text string"
NODE = "id string, label string, type string"
EDGE = "source string, target string, type string, weight bigint"
MANIFEST = (
    "collections array<struct<collection_id:string, documents:array<struct<document_id:string, title:string, author:string, date:string, document_type:string, "
    "source_url:string, source_format:string, chunk_strategy:string, default_issue_tags:array<string>>>>>"
)
TRANSCRIPT = "term string, caseName string, caseTranscripts array<struct<transcript:array<struct<speakerName:string, textObjs:array<struct<text:string>>>>>>"
NODE_LINK = "nodes array<struct<id:string, label:string, type:string>>, links array<struct<source:string, target:string, type:string, weight:bigint>>"
#: Phases of the timeline, in the order in which they are listed.
PHASES = ("amendment", "convention", "debate", "implementation", "ratification")
