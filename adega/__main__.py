from adega.plans.cli import main

main()
