"""Plan helpers: materialised intermediates and registered queries."""
