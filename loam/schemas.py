"""Schemas of the tables that operators exchange."""

ARTICLE = (
    "id string, article_id string, locale string, title string, url string, scraped_at timestamp, last_modified string, affected_devices array<string>, macos_versions array<string>, "
    "difficulty_tier int, category string, categories array<string>, summary string, sections array<struct<heading:string,body:string>>, steps array<string>, embed_text string, source string"
)
CHUNK = (
    "chunk_id string, section_heading string, text string, article_id string, locale string, title string, url string, affected_devices array<string>, macos_versions array<string>, "
    "difficulty_tier int, category string, source string, scraped_at timestamp"
)
PAYLOAD = ["chunk_id", "article_id", "locale", "title", "url", "affected_devices", "macos_versions", "difficulty_tier", "category", "source", "section_heading", "scraped_at", "text"]
USAGE = "user_id string, session_id string, ts timestamp, llm_calls int, input_tokens long, output_tokens long, cost_usd double, estimated boolean, error_type string"
