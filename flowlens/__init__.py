"""Part of flowlens."""
