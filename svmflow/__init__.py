"""svmflow: distributed SVM training, scoring and text-data jobs on PySpark."""
