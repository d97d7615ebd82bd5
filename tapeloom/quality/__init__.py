"""Data-quality rules, the market-data contract and their rollups."""
