"""Fixed schemas of the tables that the library reads and writes."""

DOCUMENT = "id string, title string, context string, text string"
META = "key string, value string"
TOMBSTONE = "kind string, key string, batch long"
