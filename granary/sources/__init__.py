"""Tables: Parquet segments and manifests."""
