"""Reports and exports of results that were selected already, so their size is bounded by budget."""
