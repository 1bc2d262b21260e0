"""The preprocessing job as a script for spark-submit; see lamina/jobs/preprocess.py."""

from lamina.jobs.preprocess import main

main()
