"""File catalogs, listings, announcements, chunk stores and raster files as DataFrames."""
