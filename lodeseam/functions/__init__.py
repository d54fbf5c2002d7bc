"""Column functions: tokenizers, estimators and rule classifiers, all JVM-side."""
