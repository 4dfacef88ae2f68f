"""Overlay tiles, sidecars, forecast fields and registry documents."""
