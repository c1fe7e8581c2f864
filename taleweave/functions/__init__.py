"""Part of taleweave; see the README for the layout."""
