"""The engine over the operators: catalog, stages, command line."""
