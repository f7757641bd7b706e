"""Column functions (Column in, Column out). All run in the JVM; none calls Python per row."""

from pagevault.functions.classify import (  # noqa: F401
    classify_connection,
    classify_person,
    classify_title,
    contact_kind,
    funding_kind,
    is_noise,
)
from pagevault.functions.dates import (  # noqa: F401
    date_candidates,
    founded_year,
    is_month_day,
    is_relative_time,
    month_day_clean,
    parse_date,
)
from pagevault.functions.jsoncols import (  # noqa: F401
    array_or_empty,
    from_wkt,
    image_items,
    items_concat,
    json_or_default,
    jsonld_fields,
    split_keywords,
    text_items,
    to_wkt,
)
from pagevault.functions.numbers import counts_from_text, digits_only, parse_metric  # noqa: F401
from pagevault.functions.social import (  # noqa: F401
    author_link,
    bio_after_action,
    chunk_header,
    extract_hashtags,
    extract_urls,
    linkify,
    metrics_line,
    name_handle,
    post_markdown,
)
from pagevault.functions.text import (  # noqa: F401
    caption_clean,
    clean_whitespace,
    clip_text,
    dedup_words,
    drop_banner,
    normalize_text,
    slugify,
    strip,
    strip_affixes,
    trim_code_head,
)
from pagevault.functions.urls import (  # noqa: F401
    absolute_url,
    base_url,
    is_plain_text,
    is_url,
    normalize_url,
    resolve_image_path,
    same_resource,
    strip_query,
    url_host,
    url_path,
)
