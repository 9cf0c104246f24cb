"""Table schemas."""

RULE = (
    "id string, city string, district string, source_name string, category string, url string, encoding string, "
    "parser_type string, verified boolean, max_pages int, page_pattern string, params map<string,string>, "
    "json_path struct<list:string,title:string,link:string,date:string,html:string>, "
    "selectors struct<list_item:string,title:string,link:string,date:string>")
FETCH_LOG = "rule_id string, page int, url string, kind string, http_status int, error string, fetched_at timestamp"
RUN_LOG = ("id bigint, source_name string, city string, status string, items_found int, error_message string, "
           "created_at timestamp")
DELIVERIES = "batch_id bigint, channel_pos int, channel string, ok boolean, error string, at timestamp"
META = "key string, value string, updated_at timestamp"
CATALOG = ("pos int, city string, type string, tag string, title string, source_name string, url string, "
           "desc string, list_item string, verified boolean")
