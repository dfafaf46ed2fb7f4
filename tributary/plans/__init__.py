"""Driver-side planning: lag layouts, selection, solving on sufficient statistics, whole analyses."""
