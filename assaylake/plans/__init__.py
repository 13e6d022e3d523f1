"""Table bindings and the catalog of registered queries."""
