"""Named queries over the driver's tables; importing this registers them."""

from leafline.plans import (  # noqa: F401
    document_queries,
    evidence_package_queries,
    evidence_queries,
    fact_queries,
    locator_queries,
    merge_queries,
    output_queries,
    package_queries,
    payload_queries,
    report_queries,
    result_queries,
    run_queries,
    source_queries,
    store_queries,
    table_queries,
    text_queries,
    tree_queries,
)
