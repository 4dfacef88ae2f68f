"""DataFrame operators over cells, frames and catalogs."""
